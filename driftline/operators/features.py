"""Feature engineering that never looks at held-out rows.

The state of a fit is a short list of means, deviations and categories; applying
it is a plain projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import FeatureError, MissingColumnError
from driftline.functions.scalars import clean_double, stable_hash
from driftline.session import materialise

# Defaults of the feature step.
MAX_CATEGORIES = 10
TEST_SIZE = 0.2
SEED = 42
SPLIT_COLUMN = "is_train"

_SCALED = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_HASH_BITS = 60
_SPLIT_ROWS = 1_000_000  # rows ranked by one task, at most 2**20 counts per class
_FEW_CLASSES = 10_000  # so many (class, limit) rows are broadcast


@dataclass(frozen=True)
class ColumnRoles:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    ignored: tuple[str, ...]


def column_roles(df: DataFrame, target: str) -> ColumnRoles:
    """Numbers of 32 and 64 bits are scaled, strings encoded, all else ignored."""
    if target not in df.columns:
        raise MissingColumnError(f"target column {target} not found among {df.columns}")
    fields = [f for f in df.schema.fields if f.name != target]
    numeric = [f.name for f in fields if isinstance(f.dataType, _SCALED)]
    categorical = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    ignored = [f.name for f in fields if f.name not in numeric + categorical]
    return ColumnRoles(tuple(numeric), tuple(categorical), tuple(ignored))


# --- cardinality --------------------------------------------------------------


def cardinality_filter(
    df: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES
) -> DataFrame:
    """``(column, n_unique, kept)``; nulls are not counted.

    Every column is counted exactly: values are made distinct before the count,
    with a partial step before the shuffle.
    """
    spark = df.sparkSession
    schema = "column string, n_unique long, kept boolean"
    if not columns:
        return spark.createDataFrame([], schema)
    bound = max(max_categories, 0)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).filter(F.col("v").isNotNull())
    counted = values.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    exact = {r["column"]: r["n"] for r in counted.collect()}  # one row per column
    return spark.createDataFrame([(c, exact.get(c, 0), exact.get(c, 0) <= bound) for c in columns], schema)


# --- split --------------------------------------------------------------------


def _smallest_hashes(df: DataFrame, group: str, share: float, few: bool, rows: int) -> DataFrame:
    """``(group, limit)``: the ceil(share*n)-th smallest hash of every group.

    A histogram over the leading hash bits finds the bucket that holds it; only
    the rows of that bucket are ranked. With ``few`` groups the wanted buckets
    (one row per group) are broadcast instead of shuffling all rows.
    """
    # The more rows, the more bits, so that a bucket stays about as large.
    bits = min(20, max(12, math.ceil(math.log2(rows / _SPLIT_ROWS)))) if rows else 12
    shift = _HASH_BITS - bits
    hashed = df.select(group, "_h", F.shiftright("_h", shift).alias("_b"))
    per_bucket = hashed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    whole = W.partitionBy(group)  # at most 2**bits rows per group
    wanted = (
        per_bucket.withColumn("_n", F.sum("_c").over(whole))
        .withColumn("_end", F.sum("_c").over(whole.orderBy("_b")))
        .withColumn("_k", F.ceil(F.lit(share) * F.col("_n")))
        .filter((F.col("_end") >= F.col("_k")) & (F.col("_end") - F.col("_c") < F.col("_k")))
        .select(group, "_b", (F.col("_k") - (F.col("_end") - F.col("_c"))).alias("_rank"))
    )
    side = F.broadcast(wanted) if few else wanted
    ranked = hashed.join(side, [group, "_b"]).withColumn(
        "_row", F.row_number().over(W.partitionBy(group).orderBy("_h"))
    )
    return ranked.filter(F.col("_row") == F.col("_rank")).select(group, F.col("_h").alias("_limit"))


def stratified_split(
    df: DataFrame,
    target: str,
    key: str | Sequence[str],
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``is_train`` (1/0): per class, the ceil(test_size*n) smallest key hashes are held out.

    ``key`` must identify a row; the split depends on the keys and the seed
    only, not on partitioning. If a class has a single row, or there are more
    classes than held-out rows (a continuous target), the split ignores classes.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if target not in df.columns:
        raise MissingColumnError(f"target column {target} not found")
    identity = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    classes = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    shape = classes.agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")
    ).first()
    total = shape["n"] or 0
    held_out = math.ceil(test_size * total)
    plain = total == 0 or shape["least"] < 2 or shape["classes"] > min(held_out, total - held_out)
    if plain:
        hashed = df.withColumn("_h", stable_hash(identity, seed))
        # One global group: its limit is a single number.
        group = hashed.select(F.lit("all").alias("_class"), "_h")
        limit = _smallest_hashes(group, "_class", test_size, True, total).first()
        bound = limit["_limit"] if limit else -1
        return hashed.withColumn(
            SPLIT_COLUMN, F.when(F.col("_h") > bound, 1).otherwise(0)
        ).drop("_h")
    klass = F.coalesce(F.col(target).cast("string"), F.lit("\0"))
    hashed = df.withColumn("_h", stable_hash(identity, seed)).withColumn("_class", klass)
    # One row per class; kept, because later steps read the split several times.
    few = shape["classes"] <= _FEW_CLASSES
    limits = _smallest_hashes(hashed, "_class", test_size, few, total)
    if few:
        known = df.sparkSession.createDataFrame(limits.collect(), limits.schema)
        side = F.broadcast(known)
    else:
        side = materialise(limits, "split-limits")
    return (
        hashed.join(side, "_class", "left")
        .withColumn(SPLIT_COLUMN, F.when(F.col("_h") > F.col("_limit"), 1).otherwise(0))
        .drop("_h", "_class", "_limit")
    )


# --- fit and transform --------------------------------------------------------


@dataclass(frozen=True)
class FeatureState:
    """What a fit learned: ``scale`` by column, ``categories`` by column (None = null)."""

    scale: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    categories: dict[str, list[str | None]] = field(default_factory=dict)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "scale", m, s, None) for c, (m, s) in self.scale.items()]
        rows += [(c, "categories", None, None, v) for c, v in self.categories.items()]
        return spark.createDataFrame(
            rows, "column string, kind string, mean double, std double, categories array<string>"
        )

    @staticmethod
    def from_df(df: DataFrame) -> FeatureState:
        scale, categories = {}, {}
        for r in df.collect():  # one row per column
            if r["kind"] == "scale":
                scale[r["column"]] = (r["mean"], r["std"])
            else:
                categories[r["column"]] = list(r["categories"])
        return FeatureState(scale, categories)

    @property
    def columns(self) -> list[str]:
        return list(self.scale) + list(self.categories)


def choose_columns(
    df: DataFrame, target: str, max_categories: int = MAX_CATEGORIES, encode: bool = True
) -> tuple[list[str], list[str]]:
    """(columns to scale, columns to encode), decided on all rows."""
    roles = column_roles(df, target)
    chosen: list[str] = []
    if encode and roles.categorical:
        kept = cardinality_filter(df, roles.categorical, max_categories).collect()
        chosen = [r["column"] for r in kept if r["kept"]]
        if not roles.numeric and not chosen and not roles.ignored:
            raise FeatureError(
                f"no features remain besides {target}: all of {list(roles.categorical)} have more "
                f"than {max_categories} categories"
            )
    return list(roles.numeric), chosen


def learn(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> FeatureState:
    """Means, deviations and categories of the given rows, in one pass.

    ``categorical`` columns hold few values, which :func:`choose_columns` checked.
    """
    aggregates = [F.avg(clean_double(c)).alias(f"m_{i}") for i, c in enumerate(numeric)]
    aggregates += [F.stddev_pop(clean_double(c)).alias(f"s_{i}") for i, c in enumerate(numeric)]
    aggregates += [F.collect_set(c).alias(f"v_{i}") for i, c in enumerate(categorical)]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"z_{i}") for i, c in enumerate(categorical)]
    if not aggregates:
        return FeatureState()
    found = train.agg(*aggregates).first()
    return FeatureState(
        {c: (found[f"m_{i}"], found[f"s_{i}"]) for i, c in enumerate(numeric)},
        {
            c: sorted(found[f"v_{i}"]) + ([None] if found[f"z_{i}"] else [])
            for i, c in enumerate(categorical)
        },
    )


def fit(
    df: DataFrame,
    target: str,
    max_categories: int = MAX_CATEGORIES,
    encode: bool = True,
    split: str = SPLIT_COLUMN,
) -> FeatureState:
    """Learns scaling and categories from the train rows of ``df``.

    Which columns are worth encoding is decided on all rows.
    """
    marked = split in df.columns
    numeric, categorical = choose_columns(
        df.drop(split) if marked else df, target, max_categories, encode
    )
    return learn(df.filter(F.col(split) == 1) if marked else df, numeric, categorical)


def scaled(column: str, mean: float | None, std: float | None) -> Column:
    """z-score; a constant column is only centred."""
    centred = clean_double(column) - F.lit(mean).cast("double")
    return centred / F.lit(std if std else 1.0)


def encoded(column: str, categories: Sequence[str | None]) -> dict[str, Column]:
    """0/1 columns per category. Two categories give one column; unknown values give zeros."""
    shown = list(categories)[1:] if len(categories) == 2 else list(categories)
    out = {}
    for value in shown:
        name = "nan" if value is None else value
        hit = F.col(column).isNull() if value is None else F.col(column) == F.lit(value)
        out[f"{column}_{name}"] = F.when(hit, 1.0).otherwise(0.0)
    return out


def transform(df: DataFrame, state: FeatureState, keep: Sequence[str] = ()) -> DataFrame:
    """Feature columns ``scaler__c`` and ``encoder__c_v`` plus the kept columns.

    A state that learned nothing passes the table through.
    """
    if not state.columns:
        return df
    missing = [c for c in state.columns if c not in df.columns]
    if missing:
        raise MissingColumnError(f"columns {missing} are needed by the fitted state")
    out = [scaled(c, m, s).alias(f"scaler__{c}") for c, (m, s) in state.scale.items()]
    for column, categories in state.categories.items():
        out += [col.alias(f"encoder__{name}") for name, col in encoded(column, categories).items()]
    return df.select(*out, *keep)


def build_features(
    df: DataFrame,
    target: str,
    key: str | Sequence[str],
    keep: Sequence[str] = (),
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    max_categories: int = MAX_CATEGORIES,
    encode: bool = True,
) -> tuple[DataFrame, FeatureState]:
    """Split, fit on train rows, transform all rows. Row count and target are unchanged."""
    keys = [key] if isinstance(key, str) else list(key)
    data = df.drop(*[k for k in keys if k != target])
    numeric, categorical = choose_columns(data, target, max_categories, encode)
    split = stratified_split(df, target, keys, test_size, seed)
    learned = learn(split.filter(F.col(SPLIT_COLUMN) == 1), numeric, categorical)
    return transform(split, learned, [*keep, target, SPLIT_COLUMN]), learned


# --- alignment of serving rows ------------------------------------------------


def align_named(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The expected columns in the expected order; raises if one is missing."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise MissingColumnError(f"rows lack the columns {missing}")
    return df.select(*expected)


def align_positional(
    df: DataFrame, array: str, expected: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Names the items of an array column by position; a row of another length fails the job."""
    n = len(expected)
    checked = F.when(F.size(array) == n, F.col(array)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {n} features, got "), F.size(array).cast("string")))
    )
    return df.withColumn("_a", checked).select(
        *keep, *[F.col("_a")[i].cast("double").alias(c) for i, c in enumerate(expected)]
    )


def misaligned_rows(df: DataFrame, array: str, width: int) -> DataFrame:
    """Rows whose array does not have the expected length."""
    return df.filter(F.coalesce(F.size(array), F.lit(-1)) != width)
