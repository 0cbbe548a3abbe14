"""Drift of lineitem: shipped before 1998 against shipped later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import drift
from driftline.plans.registry import at_edge, query, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
CUT = "1998-01-01"


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "lineitem")
    before = F.col("l_shipdate") < F.lit(CUT).cast("timestamp")
    columns = NUMERIC + CATEGORICAL
    return items.filter(before).select(*columns), items.filter(~before).select(*columns)


def unpivot_sql(source: str, numeric: list[str]) -> str:
    """CTEs ``both_sides`` (with ``cur``) and ``long`` (cur, feature, v) of a relation."""
    parts = " UNION ALL ".join(
        f"SELECT cur, '{c}' AS feature, {c}::DOUBLE AS v FROM both_sides" for c in numeric
    )
    return f"both_sides AS ({source}), long AS ({parts})"


def numeric_sql(source: str, numeric: list[str]) -> str:
    """CTEs ``num`` and ``pv``: statistics and KS p-values of numeric features."""
    return f"{unpivot_sql(source, numeric)}, {_NUMERIC_BODY}"


def categorical_sql(categorical: list[str]) -> str:
    """CTE ``cat``: statistics of categorical features of ``both_sides``."""
    parts = " UNION ALL ".join(
        f"SELECT cur, '{c}' AS feature, {c} AS v FROM both_sides" for c in categorical
    )
    return f"clong AS ({parts}), {_CATEGORICAL_BODY}"


def scored_sql(source: str, numeric: list[str], categorical: list[str]) -> str:
    """CTE ``result``: score and severity of every feature."""
    return f"{numeric_sql(source, numeric)}, {categorical_sql(categorical)}, {_SCORED_BODY}"


_NUMERIC_BODY = """
m AS (
  SELECT feature, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur,
    avg(v) FILTER (NOT cur) AS ref_mean, avg(v) FILTER (cur) AS cur_mean,
    stddev_samp(v) FILTER (NOT cur) AS ref_std, stddev_samp(v) FILTER (cur) AS cur_std,
    min(v) AS lo, max(v) AS hi
  FROM long GROUP BY feature),
vc AS (
  SELECT feature, v, count(*) FILTER (NOT cur) AS cr, count(*) FILTER (cur) AS cc
  FROM long GROUP BY feature, v),
cdf AS (
  SELECT feature, sum(cr) OVER w AS sr, sum(cc) OVER w AS sc FROM vc
  WINDOW w AS (PARTITION BY feature ORDER BY v)),
ks AS (
  SELECT feature, max(abs(sr / n_ref - sc / n_cur)) AS ks_statistic
  FROM cdf JOIN m USING (feature) GROUP BY feature),
bins AS (SELECT feature, b, n_ref, n_cur, (hi - lo) / 10 AS w FROM m, range(10) AS r(b)),
hist AS (
  SELECT feature, least(floor((v - lo) * 10.0 / (hi - lo)), 9)::BIGINT AS b,
    count(*) FILTER (NOT cur) AS cr, count(*) FILTER (cur) AS cc
  FROM long JOIN m USING (feature) GROUP BY 1, 2),
cells AS (
  SELECT feature, n_ref, n_cur, w, coalesce(cr, 0) AS cr, coalesce(cc, 0) AS cc
  FROM bins LEFT JOIN hist USING (feature, b)),
props AS (
  SELECT *, (cr + 1) / (n_ref + 10) AS pr, (cc + 1) / (n_cur + 10) AS pc,
    cr / (n_ref * w) + 1e-10 AS dr, cc / (n_cur * w) + 1e-10 AS dc FROM cells),
dens AS (
  SELECT *, dr / sum(dr) OVER (PARTITION BY feature) AS p,
    dc / sum(dc) OVER (PARTITION BY feature) AS q FROM props),
binned AS (
  SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi,
    sqrt(greatest(sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))), 0))
      AS js_distance
  FROM dens GROUP BY feature),
num AS (
  SELECT *, (ks_statistic + js_distance) / 2 AS drift_score,
    sqrt(n_ref::DOUBLE * n_cur / (n_ref + n_cur)) * ks_statistic AS lam
  FROM m JOIN ks USING (feature) JOIN binned USING (feature)),
pv AS (
  SELECT feature, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(least(
      2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * lam * lam)), 1), 0)
    END AS ks_pvalue
  FROM num, range(1, 101) AS r(k) GROUP BY feature, lam)
"""

_CATEGORICAL_BODY = """
ccount AS (
  SELECT feature, v, count(*) FILTER (NOT cur) AS cr, count(*) FILTER (cur) AS cc
  FROM clong GROUP BY feature, v),
ctot AS (
  SELECT feature, sum(cr) AS n_ref, sum(cc) AS n_cur, sum(cr + 1) AS s_ref, sum(cc + 1) AS s_cur,
    count(*) FILTER (cr > 0) AS k_ref, count(*) FILTER (cc > 0) AS k_cur
  FROM ccount GROUP BY feature),
cchi AS (
  SELECT feature, sum(((cc + 1) - (cr + 1) * (s_cur / s_ref)) ** 2 / ((cr + 1) * (s_cur / s_ref)))
    AS chi_squared
  FROM ccount JOIN ctot USING (feature) GROUP BY feature),
cat AS (
  SELECT feature, n_ref::BIGINT AS n_ref, n_cur::BIGINT AS n_cur, chi_squared,
    CASE WHEN least(k_ref, k_cur) > 1
      THEN sqrt(chi_squared / ((n_ref + n_cur) * (least(k_ref, k_cur) - 1))) ELSE 0 END AS cramers_v
  FROM ctot JOIN cchi USING (feature))
"""

_SCORED_BODY = """
scored AS (
  SELECT feature, 'numeric' AS kind, n_ref, n_cur, drift_score, ks_statistic, psi FROM num
  UNION ALL
  SELECT feature, 'categorical', n_ref, n_cur, cramers_v, chi_squared / (chi_squared + n_ref), 0.0
  FROM cat),
result AS (
  SELECT *, CASE WHEN drift_score >= 0.1 THEN 'critical' WHEN drift_score >= 0.05 THEN 'warning'
    ELSE 'none' END AS severity FROM scored)
"""

_SOURCE = "SELECT l_shipdate >= TIMESTAMP '1998-01-01' AS cur, * FROM lineitem"
_UNPIVOT = unpivot_sql(_SOURCE, NUMERIC)
_NUMERIC_CTE = numeric_sql(_SOURCE, NUMERIC)
_CATEGORICAL_CTE = categorical_sql(CATEGORICAL)
_ALL_CTE = scored_sql(_SOURCE, NUMERIC, CATEGORICAL)

METRIC_ROWS = """
SELECT feature, 'drift_score' AS metric, NULL::VARCHAR AS severity, round(drift_score, 6) AS value FROM result
UNION ALL SELECT feature, 'ks_statistic', NULL, round(ks_statistic, 6) FROM result
UNION ALL SELECT feature, 'psi_score', NULL, round(psi, 6) FROM result
UNION ALL SELECT feature, 'drift_detected_total', severity, 1.0 FROM result WHERE severity <> 'none'
"""


@query(
    "drift_numeric",
    f"""WITH {_NUMERIC_CTE}
    SELECT feature, n_ref, n_cur, round(ks_statistic, 6) AS ks_statistic,
      round(ks_pvalue, 6) AS ks_pvalue, round(psi, 6) AS psi,
      round(js_distance, 6) AS js_distance, round(drift_score, 6) AS drift_score,
      round(ref_mean, 6) AS ref_mean, round(cur_mean, 6) AS cur_mean,
      round(ref_std, 6) AS ref_std, round(cur_std, 6) AS cur_std
    FROM num JOIN pv USING (feature)""",
)
def drift_numeric(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(spark, sf)
    return at_edge(
        drift.numeric_drift(before, after, NUMERIC).select(
            "feature",
            "n_ref",
            "n_cur",
            "ks_statistic",
            "ks_pvalue",
            "psi",
            "js_distance",
            ((F.col("ks_statistic") + F.col("js_distance")) / 2).alias("drift_score"),
            "ref_mean",
            "cur_mean",
            "ref_std",
            "cur_std",
        )
    )


@query(
    "drift_categorical",
    f"""WITH {_UNPIVOT}, {_CATEGORICAL_CTE}
    SELECT feature, n_ref, n_cur, round(chi_squared, 6) AS chi_squared,
      round(cramers_v, 6) AS cramers_v FROM cat""",
)
def drift_categorical(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(spark, sf)
    return at_edge(
        drift.categorical_drift(before, after, CATEGORICAL).select(
            "feature", "n_ref", "n_cur", "chi_squared", "cramers_v"
        )
    )


@query(
    "drift_features",
    f"""WITH {_ALL_CTE}
    SELECT feature, kind, n_ref, n_cur, round(drift_score, 6) AS drift_score,
      round(ks_statistic, 6) AS ks_statistic, round(psi, 6) AS psi, severity,
      severity <> 'none' AS is_drifted, psi > 0.2 AS psi_exceeds
    FROM result""",
)
def drift_features(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(spark, sf)
    return at_edge(
        drift.detect_drift(before, after).select(
            "feature", "kind", "n_ref", "n_cur", "drift_score", "ks_statistic", "psi",
            "severity", "is_drifted", "psi_exceeds",
        )
    )


@query(
    "drift_report",
    f"""WITH {_ALL_CTE},
    t AS (SELECT count(*) AS n, count(*) FILTER (severity <> 'none') AS d, avg(drift_score) AS s
          FROM result)
    SELECT n AS features_analyzed, d AS features_drifted, round(s, 6) AS overall_drift_score,
      CASE WHEN s >= 0.1 THEN 'critical' WHEN s >= 0.05 THEN 'warning' ELSE 'none' END AS severity,
      CASE WHEN s >= 0.1 THEN format('CRITICAL: Significant drift detected in {{}}/{{}} features ({{:.1f}}%). Immediate model retraining recommended. Review feature pipelines for data quality issues.', d, n, 100.0 * d / n)
        WHEN s >= 0.05 THEN format('WARNING: Moderate drift detected in {{}}/{{}} features ({{:.1f}}%). Schedule model retraining and investigate root causes of drift.', d, n, 100.0 * d / n)
        ELSE format('OK: No significant drift detected. {{}} features analyzed. Continue monitoring.', n)
      END AS recommendation
    FROM t""",
)
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(spark, sf)
    return at_edge(drift.drift_report(drift.detect_drift(before, after)))


@query(
    "drift_top10",
    f"""WITH {_ALL_CTE}
    SELECT feature, round(drift_score, 6) AS drift_score FROM result
    ORDER BY result.drift_score DESC, feature LIMIT 10""",
)
def drift_top10(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(spark, sf)
    return at_edge(
        drift.top_drifted(drift.detect_drift(before, after)).select("feature", "drift_score")
    )


@query(
    "drift_rollup",
    f"""WITH {_ALL_CTE}
    SELECT round(max(drift_score), 6) AS max_score, round(max(ks_statistic), 6) AS max_ks,
      count(*) FILTER (drift_score > 0.01) AS features_above FROM result""",
)
def drift_rollup(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(spark, sf)
    return at_edge(drift.drift_rollup(drift.detect_drift(before, after), above=0.01))


@query(
    "drift_metrics",
    f"""WITH {_ALL_CTE}
    SELECT 'returns' AS model, TIMESTAMP '2001-12-01' AS ts, * FROM ({METRIC_ROWS})""",
)
def drift_metrics(spark: SparkSession, sf: str) -> DataFrame:
    before, after = sides(spark, sf)
    as_of = F.lit("2001-12-01").cast("timestamp")
    return at_edge(drift.drift_metrics(drift.detect_drift(before, after), "returns", as_of))


@query(
    "drift_skipped",
    """SELECT feature, status FROM (
      SELECT 'o_totalprice' AS feature, 'skipped_empty_current' AS status,
        (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL) AS n
      UNION ALL SELECT 'o_clerk', 'skipped_missing_in_current', 1) WHERE n > 0""",
)
def drift_skipped(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    reference = orders.filter("o_orderstatus = 'F'").select(
        "o_orderpriority", "o_totalprice", F.col("o_custkey").alias("o_clerk")
    )
    current = orders.filter("o_orderstatus <> 'F'").select(
        "o_orderpriority", F.lit(None).cast("double").alias("o_totalprice")
    )
    return drift.skipped_features(reference, current)


@query(
    "profile_numeric",
    f"""WITH {_UNPIVOT}
    SELECT feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
      round(min(v), 6) AS min, round(max(v), 6) AS max,
      round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
      round(quantile_cont(v, 0.75), 6) AS q75
    FROM long GROUP BY feature""",
)
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(drift.numeric_profile(table(spark, sf, "lineitem"), NUMERIC))


@query(
    "profile_histogram",
    f"""WITH {_UNPIVOT},
    m AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature),
    h AS (
      SELECT feature, least(floor((v - lo) * 10.0 / (hi - lo)), 9)::INT AS bin, count(*) AS n
      FROM long JOIN m USING (feature) GROUP BY 1, 2),
    f AS (SELECT feature, b::INT AS bin, lo, hi FROM m, range(10) AS r(b))
    SELECT feature, bin, round(lo + bin * ((hi - lo) / 10), 6) AS low,
      round(lo + (bin + 1) * ((hi - lo) / 10), 6) AS high, coalesce(n, 0) AS n
    FROM f LEFT JOIN h USING (feature, bin)""",
)
def profile_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(drift.histogram(table(spark, sf, "lineitem"), NUMERIC))


@query(
    "profile_categorical",
    f"""WITH {_UNPIVOT}, {_CATEGORICAL_CTE}
    SELECT feature, v AS value, count(*) AS n,
      round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 6) AS share
    FROM clong GROUP BY feature, v""",
)
def profile_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(drift.categorical_profile(table(spark, sf, "lineitem"), CATEGORICAL))
