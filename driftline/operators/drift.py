"""Drift between a reference table and a current table.

Numeric features: Kolmogorov-Smirnov statistic, population stability index and
Jensen-Shannon distance. Categorical features: chi-squared and Cramer's V.

Plan for numeric features (all exact):

1. one pass gives counts, moments, extremes and a mergeable quantile sketch per
   feature and side. They are written as a small table; the sketches' quantiles
   cut the values of a feature into ranges;
2. one pass counts both sides per (feature, range, histogram bucket). That
   settles PSI and JS, and bounds the KS distance inside every range;
3. only ranges whose bound beats the best distance seen at a range edge are
   read again, value by value, with prefix sums over the values. A range that
   holds many values is split by row rank, so no task sorts a whole range.

The cuts stay in the written table: rows look their range up in it by a binary
search of projections. :func:`store_profile` keeps the same things of a
reference for good; :func:`drift_against` then compares tables with it without
reading the reference again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import DataError
from driftline.functions.order_stats import LINEAR, exact_quantiles, unpivot
from driftline.functions.scalars import clean_double, equal_width_bucket, ratio
from driftline.functions.segments import HOT_ROWS, running_totals
from driftline.functions.statistics import chi2_p_value, kolmogorov_p_value
from driftline.session import materialise, new_shared_path

# Default thresholds, bins and smoothing of the drift statistics.
DRIFT_THRESHOLD = 0.1
WARNING_THRESHOLD = 0.05
PSI_THRESHOLD = 0.2
N_BINS = 10
DENSITY_SMOOTHING = 1e-10

# Recommendation texts (drifted, analysed, share in percent).
CRITICAL_TEXT = (
    "CRITICAL: Significant drift detected in %d/%d features (%.1f%%). "
    "Immediate model retraining recommended. "
    "Review feature pipelines for data quality issues."
)
WARNING_TEXT = (
    "WARNING: Moderate drift detected in %d/%d features (%.1f%%). "
    "Schedule model retraining and investigate root causes of drift."
)
OK_TEXT = "OK: No significant drift detected. %d features analyzed. Continue monitoring."

_NUMERIC = (T.NumericType, T.BooleanType)


@dataclass(frozen=True)
class DriftConfig:
    drift_threshold: float = DRIFT_THRESHOLD
    warning_threshold: float = WARNING_THRESHOLD
    psi_threshold: float = PSI_THRESHOLD
    n_bins: int = N_BINS
    # How finely the values of a feature are cut; affects speed only.
    rows_per_range: int = 2_000_000
    min_ranges: int = 64
    max_ranges: int = 1024


# Ranges (six numbers each) that are broadcast when values are read again.
BROADCAST_RANGES = 100_000
# Fixed size of a feature's quantile sketch: its ranks err by about 0.6 percent.
SKETCH_K = 512
# Bytes of a table (as Spark estimates them) that go into the sketches; of larger ones a share of the rows does.
SKETCH_BYTES = 64 << 30
# Cuts of all features together that rows look their ranges up in.
MOST_CUTS = 1 << 20
# Open ranges that are named in the filter over a stored reference's values.
NAMED_RANGES = 1_000


def is_numeric(field: T.StructField) -> bool:
    """Drift's notion of numeric: any number, booleans included."""
    return isinstance(field.dataType, _NUMERIC)


def split_columns(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None
) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, missing in current) columns of the reference."""
    wanted = list(columns) if columns is not None else reference.columns
    fields = {f.name: f for f in reference.schema.fields}
    shared = [c for c in wanted if c in current.columns]
    numeric = [c for c in shared if is_numeric(fields[c])]
    categorical = [c for c in shared if c not in numeric]
    return numeric, categorical, [c for c in wanted if c not in current.columns]


# --- profiles -----------------------------------------------------------------


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, max and exact quartiles per numeric column."""
    long = unpivot(df, columns).filter(F.col("value").isNotNull())
    moments = long.groupBy("feature").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75], LINEAR)
    return moments.join(quartiles.drop("n"), "feature").select(
        "feature",
        "n",
        "mean",
        "std",
        "min",
        "max",
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"),
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = N_BINS) -> DataFrame:
    """Equal-width histogram per numeric column, empty bins included.

    A constant column gets a range of one unit centred on its value.
    """
    long = unpivot(df, columns).filter(F.col("value").isNotNull())
    limits = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    limits = limits.select(
        "feature",
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    counts = (
        long.join(F.broadcast(limits), "feature")  # one row per column
        .groupBy(
            "feature",
            equal_width_bucket(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = limits.select(
        "feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def _categories(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(pairs)).filter(F.col("value").isNotNull())


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of each category, nulls left out."""
    counts = _categories(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "feature").select(  # one row per column
        "feature", "value", "n", (F.col("n") / F.col("total")).alias("share")
    )


# --- numeric statistics -------------------------------------------------------


def _wide(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both sides below each other: ``cur`` and the values as ``v0, v1 ...``."""
    return _side(reference, False, columns).unionAll(_side(current, True, columns))


def _side(df: DataFrame, cur: bool, columns: Sequence[str]) -> DataFrame:
    return df.select(
        F.lit(cur).alias("cur"), *[clean_double(c).alias(f"v{i}") for i, c in enumerate(columns)]
    )


def _measured(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(cur, id, feature, n, mean, std, min, max, sketch)`` per side and feature, in one pass, written."""
    size = int(wide._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    share = min(1.0, SKETCH_BYTES / max(size, 1))
    ids = range(len(columns))
    if share < 1.0:
        wide = wide.withColumn("_in", F.rand(7) < share)
        wide = wide.withColumns({f"s{i}": F.when(F.col("_in"), F.col(f"v{i}")) for i in ids})
    aggregates = [
        F.struct(
            F.lit(i).alias("id"),
            F.lit(columns[i]).alias("feature"),
            F.count(f"v{i}").alias("n"),
            F.avg(f"v{i}").alias("mean"),
            F.stddev_samp(f"v{i}").alias("std"),
            F.min(f"v{i}").alias("min"),
            F.max(f"v{i}").alias("max"),
            F.kll_sketch_agg_double(f"s{i}" if share < 1.0 else f"v{i}", F.lit(SKETCH_K)).alias("sketch"),
        ).alias(f"m{i}")
        for i in ids
    ]
    found = wide.groupBy("cur").agg(*aggregates)
    return materialise(found.select("cur", F.inline(F.array(*[f"m{i}" for i in ids]))), "measured")


def _with_cuts(
    measured: DataFrame, config: DriftConfig, n_columns: int
) -> tuple[DataFrame, int]:
    """``(id, cuts)``, where each feature is cut into ranges of about equal size, and the number of ranges.

    Cuts only spread the work: every row is counted in its range, and any cuts
    give the same statistics.
    """
    total = measured.groupBy("id").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    most = max(2, min(config.max_ranges, MOST_CUTS // n_columns))
    ranges = int(min(max(total // config.rows_per_range, config.min_ranges), most))
    ranks = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    sketch = measured.groupBy("id").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    quantiles = F.when(
        F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", ranks)
    )
    finite = F.filter(quantiles, lambda x: F.abs(x) < F.lit(float("inf")))
    return sketch.select("id", F.array_sort(F.array_distinct(finite)).alias("cuts")), ranges


def _known(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row per feature with values on both sides: what is known of it, and its cuts."""

    def side(cur: bool, name: str) -> DataFrame:
        return measured.filter((F.col("cur") == cur) & (F.col("n") > 0)).select(
            "id", *(["feature"] if cur else []), F.col("n").alias(f"n_{name}"), F.col("mean").alias(f"{name}_mean"),
            F.col("std").alias(f"{name}_std"), F.col("min").alias(f"_{name}_min"), F.col("max").alias(f"_{name}_max"),
        )

    both = side(False, "ref").join(side(True, "cur"), "id").join(cuts, "id")
    return both.select(
        "id", "feature", "n_ref", "n_cur", "ref_mean", "cur_mean", "ref_std", "cur_std",
        F.least("_ref_min", "_cur_min").alias("lo"),
        F.greatest("_ref_max", "_cur_max").alias("hi"),
        # One side holds a single value.
        (
            (F.col("_ref_min") == F.col("_ref_max")) | (F.col("_cur_min") == F.col("_cur_max"))
        ).alias("degenerate"),
        F.coalesce("cuts", F.array().cast("array<double>")).alias("cuts"),
    )


def _lookup(known: DataFrame, n_columns: int) -> Column:
    """cuts, lo and hi of every feature at the place of its id, read from the written table when a query runs."""
    facts = F.map_from_entries(F.collect_list(F.struct("id", F.struct("cuts", "lo", "hi"))))
    places = F.array(*[F.lit(i) for i in range(n_columns)])
    return known.agg(F.transform(places, lambda i: F.try_element_at(facts, i))).scalar()


def _range_of(rows: DataFrame, facts: Column, most: int) -> DataFrame:
    """Adds ``r``, the number of the feature's cuts (``most`` or fewer) not above ``value``, by binary search."""
    rows = rows.withColumn("r", F.lit(0))
    step = 1 << max(most.bit_length() - 1, 0)
    while step:
        at = F.get(F.get(facts, F.col("id"))["cuts"], F.col("r") + (step - 1))
        rows = rows.withColumn("r", F.col("r") + F.when(at <= F.col("value"), step).otherwise(0))
        step //= 2
    return rows


def _bucket_of(value: Column, facts: Column, bins: int) -> Column:
    """Histogram bucket of a value over its feature's joint range."""
    own = F.get(facts, F.col("id"))
    return F.when(
        own["lo"] < own["hi"], equal_width_bucket(value, own["lo"], own["hi"], bins)
    ).otherwise(F.lit(0))


def _long(wide: DataFrame, ids: Sequence[int]) -> DataFrame:
    """``(cur, id, value)``: the values of some features below each other."""
    items = F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"v{i}").alias("value")) for i in ids])
    return wide.select("cur", F.inline(items)).filter(F.col("value").isNotNull())


def _cells(rows: DataFrame, bins: int, facts: Column) -> DataFrame:
    """Counts of both sides per (feature, range, bucket), with the extremes inside."""
    return (
        rows.withColumn("bucket", _bucket_of(F.col("value"), facts, bins))
        .groupBy("id", "r", "bucket")
        .agg(*_counts(), F.min("value").alias("v_min"), F.max("value").alias("v_max"))
    )


def _counts() -> list[Column]:
    return [
        F.count_if(~F.col("cur")).alias("c_ref"),
        F.count_if(F.col("cur")).alias("c_cur"),
    ]


def _binned(cells: DataFrame, known: DataFrame, bins: int) -> DataFrame:
    """PSI and Jensen-Shannon distance per feature, from counts per histogram bucket."""
    counted = cells.groupBy("id", "bucket").agg(
        F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur")
    )
    frame = known.select(
        "id",
        "n_ref",
        "n_cur",
        "degenerate",
        ((F.col("hi") - F.col("lo")) / bins).alias("width"),
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bucket"),
    )
    full = frame.join(counted, ["id", "bucket"], "left").fillna(0, ["c_ref", "c_cur"])
    psi_ref = (F.col("c_ref") + 1) / (F.col("n_ref") + bins)
    psi_cur = (F.col("c_cur") + 1) / (F.col("n_cur") + bins)
    width = F.col("width")
    # Densities of one side sum to 1/width before smoothing.
    scale = F.try_divide(F.lit(1.0), width) + DENSITY_SMOOTHING * bins
    js_ref = (F.try_divide(F.col("c_ref"), F.col("n_ref") * width) + DENSITY_SMOOTHING) / scale
    js_cur = (F.try_divide(F.col("c_cur"), F.col("n_cur") * width) + DENSITY_SMOOTHING) / scale
    middle = (F.col("p") + F.col("q")) / 2
    js = (F.col("p") * F.log(F.col("p") / middle) + F.col("q") * F.log(F.col("q") / middle)) / 2
    psi = (F.col("psi_cur") - F.col("psi_ref")) * F.log(F.col("psi_cur") / F.col("psi_ref"))
    return (
        full.select(
            "id",
            "degenerate",
            psi_ref.alias("psi_ref"),
            psi_cur.alias("psi_cur"),
            js_ref.alias("p"),
            js_cur.alias("q"),
        )
        .groupBy("id", "degenerate")
        .agg(F.sum(psi).alias("psi"), F.sum(js).alias("js"))
        .select(
            "id",
            F.when(F.col("degenerate"), 0.0).otherwise(F.col("psi")).alias("psi"),
            F.sqrt(F.greatest(F.coalesce("js", F.lit(0.0)), F.lit(0.0))).alias("js_distance"),
        )
    )


def _range_edges(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Per range: distribution functions at its edges, and the bound of the distance inside."""
    ranges = cells.groupBy("id", "r").agg(
        F.sum("c_ref").alias("c_ref"),
        F.sum("c_cur").alias("c_cur"),
        (F.min("v_min") < F.max("v_max")).alias("mixed"),
    )
    order = W.partitionBy("id").orderBy("r")  # at most max_ranges rows per feature
    ref_end, cur_end = F.sum("c_ref").over(order), F.sum("c_cur").over(order)
    edges = ranges.select(
        "id",
        "r",
        "mixed",
        ref_end.alias("e_ref"),
        cur_end.alias("e_cur"),
        (ref_end - F.col("c_ref")).alias("s_ref"),
        (cur_end - F.col("c_cur")).alias("s_cur"),
    ).join(F.broadcast(known.select("id", "n_ref", "n_cur")), "id")  # one row per column
    at_end = F.abs(F.col("e_ref") / F.col("n_ref") - F.col("e_cur") / F.col("n_cur"))
    inside = F.greatest(
        F.col("e_ref") / F.col("n_ref") - F.col("s_cur") / F.col("n_cur"),
        F.col("e_cur") / F.col("n_cur") - F.col("s_ref") / F.col("n_ref"),
    )
    return edges.withColumn("at_edge", F.max(at_end).over(W.partitionBy("id"))).withColumn(
        "open", F.col("mixed") & (inside > F.col("at_edge"))
    )


def _statistics(
    known: DataFrame, cells: DataFrame, values_of: Callable[[DataFrame, list[int]], DataFrame], bins: int
) -> DataFrame:
    """KS, PSI and JS from counts per cell.

    ``values_of`` gives ``(id, r, value, c_ref, c_cur)`` of the ranges that are
    still open, given as a table, in the features of the given ids.
    """
    edges = materialise(_range_edges(cells, known), "edges")
    distances = edges.select("id", F.col("at_edge").alias("d"))
    # Only features with an open range are read again, and only their open ranges kept.
    reread = sorted(r["id"] for r in edges.filter("open").select("id").distinct().collect())
    if reread:
        # At most columns * max_ranges rows; beyond BROADCAST_RANGES the joins shuffle.
        open_ranges = edges.filter("open").select("id", "r", "n_ref", "n_cur", "s_ref", "s_cur")
        if open_ranges.count() <= BROADCAST_RANGES:
            open_ranges = F.broadcast(open_ranges)
        values = materialise(values_of(open_ranges.select("id", "r"), reread), "open-values")
        hot_rows = HOT_ROWS if values.count() > HOT_ROWS else None
        inside = (
            running_totals(values, ["id", "r"], ["value"], {"d_ref": "c_ref", "d_cur": "c_cur"}, None, hot_rows)
            .join(open_ranges, ["id", "r"])
            .select(
                "id",
                F.abs(
                    (F.col("s_ref") + F.col("d_ref")) / F.col("n_ref")
                    - (F.col("s_cur") + F.col("d_cur")) / F.col("n_cur")
                ).alias("d"),
            )
        )
        distances = distances.unionAll(inside)
    ks = distances.groupBy("id").agg(F.max("d").alias("ks_statistic"))
    return (
        known.join(ks, "id")
        .join(_binned(cells, known, bins), "id")
        .withColumn(
            "ks_pvalue",
            kolmogorov_p_value(F.col("ks_statistic"), F.col("n_ref"), F.col("n_cur")),
        )
        .drop("id", "lo", "hi", "cuts")
    )


def numeric_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """KS, PSI, JS and moments per numeric feature that has values on both sides."""
    wide, n = _wide(reference, current, columns), len(columns)
    measured = _measured(wide, columns)
    cuts, ranges = _with_cuts(measured, config, n)
    known = materialise(_known(measured, cuts), "known")
    facts = _lookup(known, n)
    # At most (columns * ranges * bins) rows, read several times: written once.
    ranged = _range_of(_long(wide, range(n)), facts, ranges)
    cells = materialise(_cells(ranged, config.n_bins, facts).join(known.select("id"), "id", "left_semi"), "cells")

    def values_of(open_ranges: DataFrame, ids: list[int]) -> DataFrame:
        again = _range_of(_long(wide, ids), facts, ranges)
        return again.join(open_ranges, ["id", "r"], "left_semi").groupBy("id", "r", "value").agg(*_counts())

    return _statistics(known, cells, values_of, config.n_bins)


# --- a stored reference -------------------------------------------------------


@dataclass(frozen=True)
class DriftProfile:
    """A reference as :func:`store_profile` keeps it, and the columns it was taken of."""

    spark: SparkSession
    path: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def store_profile(
    reference: DataFrame,
    columns: Sequence[str] | None = None,
    path: str | None = None,
    config: DriftConfig = DriftConfig(),
) -> DriftProfile:
    """Writes what later comparisons need of a reference; the reference itself is not read again.

    ``measured`` (moments, extremes, quantile sketch and cuts per feature),
    ``ranges`` (count, extremes and values per range), ``values`` (count per
    value, sorted by feature and value, so that a few ranges are a few row
    groups) and ``categories``. Null and NaN are no values.
    """
    spark = reference.sparkSession
    path = path or new_shared_path(spark, "drift-profile")
    numeric, categorical, _ = split_columns(reference, reference, columns)
    if numeric:
        wide, n = _side(reference, False, numeric), len(numeric)
        measured = _measured(wide, numeric)
        cuts, ranges = _with_cuts(measured, config, n)
        measured.join(cuts, "id").write.parquet(f"{path}/measured")
        known = spark.read.parquet(f"{path}/measured").select("id", "cuts", F.col("min").alias("lo"), F.col("max").alias("hi"))
        counted = (
            _range_of(_long(wide, range(n)), _lookup(known, n), ranges)
            .groupBy("id", "r", "value")
            .agg(F.count(F.lit(1)).alias("c_ref"))
        )
        slot = (F.col("id").cast("long") * (1 << 32) + F.col("r")).alias("slot")
        counted.select(slot, "id", "r", "value", "c_ref").repartitionByRange("slot", "value").sortWithinPartitions(
            "slot", "value"
        ).write.parquet(f"{path}/values")
        spark.read.parquet(f"{path}/values").groupBy("id", "r").agg(
            F.sum("c_ref").alias("c_ref"), F.min("value").alias("v_min"), F.max("value").alias("v_max")
        ).write.parquet(f"{path}/ranges")
    if categorical:
        _categories(reference, categorical).groupBy("feature", "value").agg(
            F.count(F.lit(1)).alias("c_ref")
        ).write.parquet(f"{path}/categories")
    names = [("numeric", c) for c in numeric] + [("categorical", c) for c in categorical]
    # Written last: a profile without it was not finished.
    spark.createDataFrame(list(enumerate(names)), "id int, of struct<kind:string,name:string>").coalesce(
        1
    ).write.parquet(f"{path}/columns")
    return DriftProfile(spark, path, tuple(numeric), tuple(categorical))


def open_profile(spark: SparkSession, path: str) -> DriftProfile:
    """The profile that :func:`store_profile` wrote to ``path``."""
    rows = sorted(spark.read.parquet(f"{path}/columns").collect())  # one row per column
    kinds = {k: tuple(r["of"]["name"] for r in rows if r["of"]["kind"] == k) for k in ("numeric", "categorical")}
    return DriftProfile(spark, path, kinds["numeric"], kinds["categorical"])


def _named(df: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows of some (id, r); a short list is named in the filter, so that other row groups are skipped."""
    found = [r[0] for r in slots.select(F.col("id").cast("long") * (1 << 32) + F.col("r")).limit(NAMED_RANGES + 1).collect()]
    if len(found) <= NAMED_RANGES:
        return df.filter(F.col("slot").isin(found))
    return df.join(slots, ["id", "r"], "left_semi")


def numeric_drift_against(
    profile: DriftProfile, current: DataFrame, config: DriftConfig = DriftConfig()
) -> DataFrame:
    """As :func:`numeric_drift`, with the stored reference.

    Of the reference its ranges are read, and the values of those ranges only
    that a histogram edge cuts or that may hold the largest distance.
    """
    columns = profile.numeric
    n, bins = len(columns), config.n_bins
    wide = _side(current, True, columns)
    stored = profile.table("measured")
    measured = stored.drop("cuts").unionByName(_measured(wide, columns))
    known = materialise(_known(measured, stored.select("id", "cuts")), "known")
    facts = _lookup(known, n)
    # The stored ranges were cut with this many cuts at most.
    most = stored.agg(F.max(F.size("cuts"))).first()[0] or 0

    ranges = (
        profile.table("ranges")
        .join(F.broadcast(known.select("id")), "id", "left_semi")  # one row per column
        .withColumns({
            "low": _bucket_of(F.col("v_min"), facts, bins), "high": _bucket_of(F.col("v_max"), facts, bins)
        })
    )
    whole = ranges.filter("low = high").select("id", "r", F.col("low").alias("bucket"), "c_ref", "v_min", "v_max")
    # At most bins - 1 ranges a feature.
    cut = materialise(ranges.filter("low <> high").select("id", "r"), "cut-ranges")
    parted = (
        _named(profile.table("values"), cut)
        .withColumn("bucket", _bucket_of(F.col("value"), facts, bins))
        .groupBy("id", "r", "bucket")
        .agg(F.sum("c_ref").alias("c_ref"), F.min("value").alias("v_min"), F.max("value").alias("v_max"))
    )
    ranged = _range_of(_long(wide, range(n)), facts, most)
    no = F.lit(0).cast("long")
    sides = [
        whole.withColumn("c_cur", no),
        parted.withColumn("c_cur", no),
        _cells(ranged, bins, facts).join(F.broadcast(known.select("id")), "id", "left_semi"),
    ]
    cells = reduce(DataFrame.unionByName, sides).groupBy("id", "r", "bucket").agg(
        F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur"),
        F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"),
    )

    def values_of(open_ranges: DataFrame, ids: list[int]) -> DataFrame:
        kept = _named(profile.table("values"), open_ranges).select("id", "r", "value", "c_ref", no.alias("c_cur"))
        own = _range_of(_long(wide, ids), facts, most).join(open_ranges, ["id", "r"], "left_semi")
        own = own.select("id", "r", "value", no.alias("c_ref"), F.lit(1).cast("long").alias("c_cur"))
        return kept.unionByName(own).groupBy("id", "r", "value").agg(
            F.sum("c_ref").alias("c_ref"), F.sum("c_cur").alias("c_cur")
        )

    return _statistics(known, materialise(cells, "cells"), values_of, bins)


# --- categorical statistics ---------------------------------------------------


def categorical_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chi-squared and Cramer's V per categorical feature with values on both sides."""
    both = _categories(reference, columns, [F.lit(False).alias("cur")]).unionAll(
        _categories(current, columns, [F.lit(True).alias("cur")])
    )
    return _association(both.groupBy("feature", "value").agg(*_counts()))


def categorical_drift_against(profile: DriftProfile, current: DataFrame) -> DataFrame:
    """As :func:`categorical_drift`, with the stored reference's counts."""
    own = _categories(current, profile.categorical).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("c_cur")
    )
    both = profile.table("categories").filter(F.col("feature").isin(list(profile.categorical)))
    full = both.join(own, ["feature", "value"], "full_outer").fillna(0, ["c_ref", "c_cur"])
    return _association(full)


def _association(counts: DataFrame) -> DataFrame:
    """Chi-squared and Cramer's V from ``(feature, value, c_ref, c_cur)``."""
    totals = counts.groupBy("feature").agg(
        F.sum("c_ref").alias("n_ref"),
        F.sum("c_cur").alias("n_cur"),
        F.sum(F.col("c_ref") + 1).alias("s_ref"),
        F.sum(F.col("c_cur") + 1).alias("s_cur"),
        F.count_if(F.col("c_ref") > 0).alias("ref_categories"),
        F.count_if(F.col("c_cur") > 0).alias("cur_categories"),
        F.count(F.lit(1)).alias("categories"),
    )
    expected = (F.col("c_ref") + 1) * (F.col("s_cur") / F.col("s_ref"))
    chi = (
        counts.join(F.broadcast(totals), "feature")  # one row per column
        .groupBy("feature")
        .agg(F.sum(F.pow(F.col("c_cur") + 1 - expected, 2) / expected).alias("chi_squared"))
    )
    k = F.least("ref_categories", "cur_categories")
    size = F.col("n_ref") + F.col("n_cur")
    return (
        totals.filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0))
        .join(chi, "feature")
        .select(
            "feature",
            "n_ref",
            "n_cur",
            "ref_categories",
            "cur_categories",
            "chi_squared",
            chi2_p_value(
                F.col("chi_squared"), (F.col("categories") - 1).cast("double")
            ).alias("chi_squared_pvalue"),
            F.when(k > 1, F.sqrt(F.col("chi_squared") / (size * (k - 1))))
            .otherwise(0.0)
            .alias("cramers_v"),
        )
    )


# --- scores and reports -------------------------------------------------------


def severity(score: Column, config: DriftConfig = DriftConfig()) -> Column:
    return (
        F.when(score >= config.drift_threshold, "critical")
        .when(score >= config.warning_threshold, "warning")
        .otherwise("none")
    )


_RESULT = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("n_ref", T.LongType()),
        T.StructField("n_cur", T.LongType()),
        T.StructField("drift_score", T.DoubleType()),
        T.StructField("ks_statistic", T.DoubleType()),
        T.StructField("ks_pvalue", T.DoubleType()),
        T.StructField("psi", T.DoubleType()),
        T.StructField("js_distance", T.DoubleType()),
        T.StructField("ref_mean", T.DoubleType()),
        T.StructField("cur_mean", T.DoubleType()),
        T.StructField("ref_std", T.DoubleType()),
        T.StructField("cur_std", T.DoubleType()),
        T.StructField("chi_squared", T.DoubleType()),
        T.StructField("cramers_v", T.DoubleType()),
        T.StructField("degenerate", T.BooleanType()),
    ]
)


def _shaped(df: DataFrame, given: dict[str, Column]) -> DataFrame:
    return df.select(
        *[
            given.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in _RESULT.fields
        ]
    )


def detect_drift(
    reference: DataFrame | None,
    current: DataFrame,
    columns: Sequence[str] | None = None,
    config: DriftConfig = DriftConfig(),
) -> DataFrame:
    """One row per feature found on both sides, with score and severity.

    Columns missing from ``current`` and columns without a value on one side
    give no row; :func:`skipped_features` names them.
    """
    if reference is None:
        raise DataError("a reference table is needed to detect drift")
    numeric, categorical, _ = split_columns(reference, current, columns)
    return _features(
        reference.sparkSession,
        numeric_drift(reference, current, numeric, config) if numeric else None,
        categorical_drift(reference, current, categorical) if categorical else None,
        config,
    )


def drift_against(
    profile: DriftProfile, current: DataFrame, config: DriftConfig = DriftConfig()
) -> DataFrame:
    """As :func:`detect_drift`, with a reference that :func:`store_profile` kept.

    Columns that ``current`` lacks give no row.
    """
    numeric = tuple(c for c in profile.numeric if c in current.columns)
    categorical = tuple(c for c in profile.categorical if c in current.columns)
    # Columns keep their places, by which the stored tables know them.
    filled = current.withColumns({c: F.lit(None).cast("double") for c in profile.numeric if c not in numeric})
    known = DriftProfile(profile.spark, profile.path, profile.numeric, categorical)
    return _features(
        profile.spark,
        numeric_drift_against(profile, filled, config) if numeric else None,
        categorical_drift_against(known, current) if categorical else None,
        config,
    )


def _features(
    spark: SparkSession, numeric: DataFrame | None, categorical: DataFrame | None, config: DriftConfig
) -> DataFrame:
    """Numeric and categorical statistics below each other, with score and severity."""
    parts = []
    if numeric is not None:
        score = (F.col("ks_statistic") + F.col("js_distance")) / 2
        parts.append(_shaped(numeric, {"kind": F.lit("numeric"), "drift_score": score}))
    if categorical is not None:
        chi = F.col("chi_squared")
        parts.append(
            _shaped(
                categorical,
                {
                    "kind": F.lit("categorical"),
                    "drift_score": F.col("cramers_v"),
                    "ks_statistic": chi / (chi + F.col("n_ref")),
                    "ks_pvalue": F.col("chi_squared_pvalue"),
                    "psi": F.lit(0.0),
                    "degenerate": F.lit(False),
                },
            )
        )
    if not parts:
        return spark.createDataFrame([], _RESULT).transform(_scored(config))
    return reduce(DataFrame.unionByName, parts).transform(_scored(config))


def _scored(config: DriftConfig):
    def add(df: DataFrame) -> DataFrame:
        level = severity(F.col("drift_score"), config)
        return df.select(
            "*",
            level.alias("severity"),
            (level != "none").alias("is_drifted"),
            (F.col("psi") > config.psi_threshold).alias("psi_exceeds"),
        )

    return add


def skipped_features(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(feature, status)`` of the reference's columns that cannot be compared."""
    numeric, categorical, missing = split_columns(reference, current, columns)
    shared = numeric + categorical
    spark = reference.sparkSession

    def present(df: DataFrame, name: str) -> DataFrame:
        if not shared:
            return spark.createDataFrame([], f"feature string, {name} long")
        return df.agg(
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in shared]), F.array(*[F.count(c) for c in shared])
            ).alias("m")
        ).select(F.explode("m").alias("feature", name))

    status = (
        F.when(F.col("n_ref") == 0, "skipped_empty_reference")
        .when(F.col("n_cur") == 0, "skipped_empty_current")
    )
    empty = (
        present(reference, "n_ref")
        .join(present(current, "n_cur"), "feature")
        .select("feature", status.alias("status"))
        .filter(F.col("status").isNotNull())
    )
    gone = spark.createDataFrame(
        [(c, "skipped_missing_in_current") for c in missing], "feature string, status string"
    )
    return gone.unionAll(empty)


def drift_report(features: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """One row: features analysed and drifted, mean score, recommendation."""
    mean = F.coalesce(F.avg("drift_score"), F.lit(0.0))
    counted = features.agg(
        F.count(F.lit(1)).alias("features_analyzed"),
        F.count_if(F.col("is_drifted")).alias("features_drifted"),
        mean.alias("overall_drift_score"),
    )
    n, drifted = F.col("features_analyzed"), F.col("features_drifted")
    share = F.coalesce(ratio(drifted, n) * 100, F.lit(0.0))
    score = F.col("overall_drift_score")
    return counted.withColumn("severity", severity(score, config)).withColumn(
        "recommendation",
        F.when(score >= config.drift_threshold, F.format_string(CRITICAL_TEXT, drifted, n, share))
        .when(score >= config.warning_threshold, F.format_string(WARNING_TEXT, drifted, n, share))
        .otherwise(F.format_string(OK_TEXT, n)),
    )


def drift_metrics(features: DataFrame, model: str, as_of: Column) -> DataFrame:
    """Long gauge table: one row per (model, feature, metric), plus a severity counter."""
    gauges = F.array(
        F.struct(F.lit("drift_score").alias("metric"), F.col("drift_score").alias("value")),
        F.struct(F.lit("ks_statistic").alias("metric"), F.col("ks_statistic").alias("value")),
        F.struct(F.lit("psi_score").alias("metric"), F.col("psi").alias("value")),
        F.struct(
            F.when(F.col("is_drifted"), "drift_detected_total").alias("metric"),
            F.lit(1.0).alias("value"),
        ),
    )
    return features.select(
        F.lit(model).alias("model"),
        "feature",
        as_of.alias("ts"),
        F.col("severity"),
        F.inline(F.filter(gauges, lambda g: g["metric"].isNotNull())),
    ).select(
        "model",
        "feature",
        "ts",
        "metric",
        F.when(F.col("metric") == "drift_detected_total", F.col("severity")).alias("severity"),
        "value",
    )


def drift_rollup(features: DataFrame, above: float = 0.1) -> DataFrame:
    """Largest score, largest KS and number of features above a score."""
    return features.agg(
        F.max("drift_score").alias("max_score"),
        F.max("ks_statistic").alias("max_ks"),
        F.count_if(F.col("drift_score") > above).alias("features_above"),
    )


def top_drifted(features: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` features with the highest score."""
    return features.orderBy(F.desc("drift_score"), "feature").limit(k)
