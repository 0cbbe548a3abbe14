"""Contracts, cleaning and feature engineering of lineitem, orders and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import clean, contract, features
from driftline.plans.registry import at_edge, query, table

ITEM_CONTRACT = contract.Contract(
    (
        contract.ColumnRule("l_quantity", "double", (contract.ge(5), contract.le(45))),
        contract.ColumnRule("l_discount", "double", (contract.ge(0), contract.le(0.07))),
        contract.ColumnRule("l_returnflag", "string", (contract.isin(["A", "R"]),)),
        contract.ColumnRule("l_orderkey", "long", (), nullable=False),
    )
)

_FAILURES = """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS "column", 'ge(5)' AS "check", l_quantity::VARCHAR AS failure_case
FROM lineitem WHERE l_quantity < 5
UNION ALL SELECT l_orderkey, l_linenumber, 'l_quantity', 'le(45)', l_quantity::VARCHAR FROM lineitem WHERE l_quantity > 45
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', 'ge(0)', l_discount::VARCHAR FROM lineitem WHERE l_discount < 0
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', 'le(0.07)', l_discount::VARCHAR FROM lineitem WHERE l_discount > 0.07
UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag', 'isin(A,R)', l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')
"""


@query("contract_failures", _FAILURES)
def contract_failures(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return contract.contract_failures(items, ITEM_CONTRACT, ["l_orderkey", "l_linenumber"])


@query(
    "contract_summary",
    """SELECT "column", "check", '' AS message, failures, (SELECT count(*) FROM lineitem) AS rows FROM (
      SELECT 'l_quantity' AS "column", 'ge(5)' AS "check", count(*) FILTER (l_quantity < 5) AS failures FROM lineitem
      UNION ALL SELECT 'l_quantity', 'le(45)', count(*) FILTER (l_quantity > 45) FROM lineitem
      UNION ALL SELECT 'l_discount', 'ge(0)', count(*) FILTER (l_discount < 0) FROM lineitem
      UNION ALL SELECT 'l_discount', 'le(0.07)', count(*) FILTER (l_discount > 0.07) FROM lineitem
      UNION ALL SELECT 'l_returnflag', 'isin(A,R)', count(*) FILTER (l_returnflag NOT IN ('A', 'R')) FROM lineitem
      UNION ALL SELECT 'l_orderkey', 'not_nullable', count(*) FILTER (l_orderkey IS NULL) FROM lineitem)""",
)
def contract_summary(spark: SparkSession, sf: str) -> DataFrame:
    return contract.contract_summary(table(spark, sf, "lineitem"), ITEM_CONTRACT)


@query(
    "structural_failures",
    """SELECT 'o_clerk' AS "column", 'column_in_dataframe' AS "check", NULL::BIGINT AS failures
    UNION ALL SELECT 'o_totalprice', 'dtype(double)', count(*) FROM orders WHERE o_orderkey % 11 = 0""",
)
def structural_failures(spark: SparkSession, sf: str) -> DataFrame:
    orders = _text_orders(spark, sf)
    rules = contract.Contract(
        (
            contract.ColumnRule("o_orderkey", "long"),
            contract.ColumnRule("o_totalprice", "double"),
            contract.ColumnRule("o_clerk", "string"),
        )
    )
    return contract.structural_failures(orders, rules)


def _text_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text, every eleventh price unreadable."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 11 == 0, "n/a")
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("o_totalprice"),
    )


@query(
    "coerce",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice
    FROM orders""",
)
def coerce(spark: SparkSession, sf: str) -> DataFrame:
    rules = contract.Contract(
        (contract.ColumnRule("o_orderkey", "long"), contract.ColumnRule("o_totalprice", "double"))
    )
    return contract.coerce(_text_orders(spark, sf), rules)


# --- cleaning -----------------------------------------------------------------


def gapped_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with nulls by key: price 1/7, customer 1/13, priority 1/5, status 2/3."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key,
        F.when(key % 13 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 3 == 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


_GAPPED = """g AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS o_orderpriority
  FROM orders)"""

_FILLED = f"""WITH {_GAPPED},
fill AS (
  SELECT median(o_custkey) AS c, median(o_totalprice) AS t,
    (SELECT o_orderpriority FROM g WHERE o_orderpriority IS NOT NULL
     GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p FROM g)"""


@query(
    "null_profile",
    f"""WITH {_GAPPED}
    SELECT c AS "column", (SELECT count(*) FROM g) AS rows, n AS nulls,
      round(n / (SELECT count(*) FROM g), 6) AS share FROM (
      SELECT 'o_orderkey' AS c, count(*) - count(o_orderkey) AS n FROM g
      UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey) FROM g
      UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus) FROM g
      UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice) FROM g
      UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority) FROM g)""",
)
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(clean.null_profile(gapped_orders(spark, sf)))


@query(
    "drop_sparse_columns",
    f"WITH {_GAPPED} SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM g",
)
def drop_sparse_columns(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_sparse_columns(gapped_orders(spark, sf))


@query(
    "impute_median",
    f"""WITH {_GAPPED}
    SELECT 'o_custkey' AS feature, count(o_custkey) AS n, round(median(o_custkey), 6) AS median FROM g
    UNION ALL SELECT 'o_totalprice', count(o_totalprice), round(median(o_totalprice), 6) FROM g""",
)
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(clean.medians(gapped_orders(spark, sf), ["o_custkey", "o_totalprice"]))


@query(
    "impute_mode",
    f"""WITH {_GAPPED},
    c AS (
      SELECT 'o_orderpriority' AS feature, o_orderpriority AS mode, count(*) AS n FROM g
      WHERE o_orderpriority IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM g
      WHERE o_orderstatus IS NOT NULL GROUP BY 2)
    SELECT feature, mode, n FROM c
    QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, mode) = 1""",
)
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    return clean.modes(gapped_orders(spark, sf), ["o_orderpriority", "o_orderstatus"])


@query(
    "clean_table",
    f"""{_FILLED}
    SELECT o_orderkey, round(coalesce(o_custkey::DOUBLE, c), 6) AS o_custkey,
      round(coalesce(o_totalprice, t), 6) AS o_totalprice,
      coalesce(o_orderpriority, p) AS o_orderpriority
    FROM g, fill""",
)
def clean_table(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(clean.clean(gapped_orders(spark, sf))[0])


@query(
    "drop_null_rows",
    f"""WITH {_GAPPED} SELECT * FROM g WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
    AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL""",
)
def drop_null_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_null_rows(gapped_orders(spark, sf))


@query(
    "validation_report",
    f"""WITH {_GAPPED}
    SELECT count(*) AS original_rows, count(*) AS clean_rows,
      4 * count(*) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice)
        - count(o_orderpriority) AS null_count,
      0::BIGINT AS rows_removed, ['o_orderstatus'] AS columns_dropped,
      ['o_custkey', 'o_totalprice', 'o_orderpriority'] AS columns_imputed FROM g""",
)
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    orders = gapped_orders(spark, sf)
    return clean.clean(orders, drop_rows=True)[1].to_df(orders)


# --- features -----------------------------------------------------------------

_HASH = "('0x' || substr(sha256({key}::VARCHAR || '|42'), 1, 15))::BIGINT"


@query(
    "column_roles",
    """SELECT * FROM (VALUES ('l_orderkey', 'numeric'), ('l_partkey', 'numeric'),
      ('l_suppkey', 'numeric'), ('l_linenumber', 'numeric'), ('l_quantity', 'numeric'),
      ('l_extendedprice', 'numeric'), ('l_discount', 'numeric'), ('l_tax', 'numeric'),
      ('l_linestatus', 'categorical'), ('l_shipdate', 'ignored')) AS t("column", role)""",
)
def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    roles = features.column_roles(items, "l_returnflag")
    named = {**{c: "numeric" for c in roles.numeric}, **{c: "categorical" for c in roles.categorical}}
    # Reads the columns' presence from the table: a role is given to columns that hold rows.
    found = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(named.get(c, "ignored")).alias("role"),
                F.count(F.lit(1)).alias("n"),
            )
            for c in items.columns
            if c != "l_returnflag"
        ]
    )
    return items.agg(found.alias("a")).select(F.inline("a")).filter("n > 0").drop("n")


@query(
    "cardinality_filter",
    """SELECT c AS "column", n AS n_unique, n <= 10 AS kept FROM (
      SELECT 'p_name' AS c, count(DISTINCT p_name) AS n FROM part
      UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
      UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)""",
)
def cardinality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return features.cardinality_filter(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query(
    "stratified_split",
    f"""SELECT c_custkey, c_mktsegment,
      CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_HASH.format(key='c_custkey')})
        > ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY c_mktsegment)) THEN 1 ELSE 0 END AS is_train
    FROM customer""",
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return features.stratified_split(customers, "c_mktsegment", "c_custkey")


@query(
    "plain_split",
    f"""SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY {_HASH.format(key='c_custkey')})
        > ceil(0.2::DOUBLE * count(*) OVER ()) THEN 1 ELSE 0 END AS is_train
    FROM customer""",
)
def plain_split(spark: SparkSession, sf: str) -> DataFrame:
    """A target with one row per value: the split falls back to ignoring it."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return features.stratified_split(customers, "c_name", "c_custkey").drop("c_name")


def order_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_orderkey").bitwiseAND(1).cast("int").alias("odd"),
        F.when(F.col("o_totalprice") > 200000, "big").otherwise("small").alias("size"),
        "o_orderstatus",
        "o_orderpriority",
    )


_SPLIT_ORDERS = f"""s AS (
  SELECT o_orderkey, o_totalprice, (o_orderkey % 2)::INT AS odd,
    CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size, o_orderstatus, o_orderpriority,
    CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH.format(key='o_orderkey')})
      > ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY o_orderpriority)) THEN 1 ELSE 0 END AS is_train
  FROM orders),
st AS (
  SELECT avg(o_totalprice) AS mt, stddev_pop(o_totalprice) AS st, avg(odd) AS mo, stddev_pop(odd) AS so
  FROM s WHERE is_train = 1)"""


@query(
    "standard_scale",
    f"""WITH {_SPLIT_ORDERS}
    SELECT 'o_totalprice' AS "column", round(mt, 4) AS mean, round(st, 4) AS std FROM st
    UNION ALL SELECT 'odd', round(mo, 4), round(so, 4) FROM st""",
)
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    _, state = features.build_features(order_features(spark, sf), "o_orderpriority", "o_orderkey")
    return at_edge(
        state.to_df(spark).filter("kind = 'scale'").select("column", "mean", "std"), 4
    )


@query(
    "one_hot",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS "o_orderstatus_F",
      (o_orderstatus = 'O')::INT::DOUBLE AS "o_orderstatus_O",
      (o_orderstatus = 'P')::INT::DOUBLE AS "o_orderstatus_P" FROM orders""",
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    state = features.fit(orders.select(F.lit(1).alias("t"), "o_orderstatus"), "t")
    named = features.encoded("o_orderstatus", state.categories["o_orderstatus"])
    return orders.select("o_orderkey", *[c.alias(n) for n, c in named.items()])


@query(
    "feature_matrix",
    f"""WITH {_SPLIT_ORDERS}
    SELECT round((o_totalprice - mt) / st, 6) AS "scaler__o_totalprice",
      round((odd - mo) / so, 6) AS "scaler__odd",
      CASE WHEN size = 'small' THEN 1.0::DOUBLE ELSE 0 END AS "encoder__size_small",
      CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END AS "encoder__o_orderstatus_F",
      CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0 END AS "encoder__o_orderstatus_O",
      CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0 END AS "encoder__o_orderstatus_P",
      o_orderkey, o_orderpriority, is_train
    FROM s, st""",
)
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    matrix, _ = features.build_features(
        order_features(spark, sf), "o_orderpriority", "o_orderkey", keep=["o_orderkey"]
    )
    return at_edge(matrix)


@query(
    "align_named",
    "SELECT l_tax, l_quantity, l_discount FROM lineitem",
)
def align_named(spark: SparkSession, sf: str) -> DataFrame:
    return features.align_named(table(spark, sf, "lineitem"), ["l_tax", "l_quantity", "l_discount"])


@query(
    "align_positional",
    """SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS f_0, round(embedding[32]::DOUBLE, 6) AS f_31,
      round(embedding[64]::DOUBLE, 6) AS f_63 FROM embeddings""",
)
def align_positional(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    names = [f"f_{i}" for i in range(64)]
    aligned = features.align_positional(vectors, "embedding", names, ["vec_id"])
    return at_edge(aligned.select("vec_id", "f_0", "f_31", "f_63"))


@query(
    "misaligned_rows",
    "SELECT vec_id, label FROM embeddings WHERE len(embedding[1:60 + vec_id % 5]) <> 64",
)
def misaligned_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors cut to 60 to 64 numbers, by their ids; only those with 64 fit."""
    kept = (60 + F.col("vec_id") % 5).cast("int")
    vectors = table(spark, sf, "embeddings").withColumn("embedding", F.slice("embedding", F.lit(1), kept))
    return features.misaligned_rows(vectors, "embedding", 64).select("vec_id", "label")


# --- gates and guards as rows ---------------------------------------------------


@query(
    "min_rows_gate",
    f"""WITH {_GAPPED}, n AS (SELECT count(*) AS rows FROM g WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL
      AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderkey IS NOT NULL)
    SELECT rows, m::BIGINT AS min_rows, rows >= m AS enough FROM n, (VALUES (10), (1000000000)) v(m)""",
)
def min_rows_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without any null against a limit they meet and one they miss."""
    whole = clean.drop_null_rows(gapped_orders(spark, sf))
    return clean.min_rows_verdict(whole).unionAll(clean.min_rows_verdict(whole, 1_000_000_000))


@query(
    "parameter_guards",
    """SELECT l_orderkey, l_linenumber, CASE WHEN NOT coalesce(l_discount * 20 - 0.2 BETWEEN 0 AND 1, false) THEN 'null_threshold must be between 0 and 1'
      WHEN NOT coalesce(l_linenumber - 1 >= 1, false) THEN 'min_rows must be at least 1' END AS problem FROM lineitem""",
)
def parameter_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as a pair of settings: a threshold from its discount, a number from its line."""
    threshold, rows = F.col("l_discount") * 20 - 0.2, F.col("l_linenumber") - 1
    problem = clean.parameter_problem(threshold, rows).alias("problem")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", problem)


@query("passthrough", "SELECT url, html FROM pages")
def passthrough(spark: SparkSession, sf: str) -> DataFrame:
    """Without numbers or encoding nothing is learned, and the kept state leaves rows as they are."""
    pages = table(spark, sf, "pages").select("url", "html")
    kept = features.fit(pages, "html", encode=False).to_df(spark)
    return features.transform(pages, features.FeatureState.from_df(kept))
