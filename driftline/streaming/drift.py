"""Drift of a stream against a fixed reference.

Two forms. :func:`drift_each_cycle` compares every micro-batch with a stored
profile of the whole reference (exact; the reference is read once, before the
first cycle).
:func:`window_counts` keeps only bucket counts per event-time window; with the
reference's fixed bin edges :func:`window_drift` then needs no reference rows.
Because the edges are fixed, PSI and JS refer to the reference's range with an
underflow and an overflow bin, not to the joint range of both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.order_stats import unpivot
from driftline.functions.scalars import equal_width_bucket
from driftline.operators.drift import (
    DENSITY_SMOOTHING,
    N_BINS,
    DriftConfig,
    DriftProfile,
    drift_against,
    drift_metrics,
    store_profile,
)
from driftline.streaming.monitoring import LATENESS
from driftline.streaming.tables import BatchWriter


def drift_each_cycle(
    reference: DataFrame | DriftProfile,
    columns: Sequence[str],
    model: str,
    path: str,
    ts: str,
    config: DriftConfig = DriftConfig(),
) -> BatchWriter:
    """Writer for a micro-batch: drift metrics against the reference, stamped with the batch's last time.

    A table is profiled here, once; a stored profile is used as it is, also by
    streams that start again.
    """
    if isinstance(reference, DataFrame):
        reference = store_profile(reference, columns, config=config)

    def write(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        kept = batch.persist()  # read once per pass of the drift operator
        try:
            as_of = kept.agg(F.max(ts).alias("t")).first()["t"]
            found = drift_against(reference, kept.select(*columns), config)
            metrics = drift_metrics(found, model, F.lit(as_of).cast("timestamp"))
            metrics.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            kept.unpersist()

    return write


def reference_bins(reference: DataFrame, columns: Sequence[str], bins: int = N_BINS) -> DataFrame:
    """``(feature, lo, hi, bin, n_ref)``: the reference's counts, bins -1 and ``bins`` empty."""
    long = unpivot(reference, columns).filter(F.col("value").isNotNull())
    limits = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    counted = (
        long.join(F.broadcast(limits), "feature")  # one row per column
        .groupBy("feature", _bin(bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_ref"))
    )
    frame = limits.withColumn("bin", F.explode(F.sequence(F.lit(-1), F.lit(bins))))
    return frame.join(counted, ["feature", "bin"], "left").fillna(0, ["n_ref"])


def _bin(bins: int):
    value, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    inside = F.coalesce(equal_width_bucket(value, lo, hi, bins), F.lit(0))
    return F.when(value < lo, -1).when(value > hi, bins).otherwise(inside)


def window_counts(
    stream: DataFrame,
    limits: DataFrame,
    columns: Sequence[str],
    window: str,
    bins: int = N_BINS,
    ts: str = "ts",
    lateness: str = LATENESS,
) -> DataFrame:
    """``(window end, feature, bin, n_cur)`` of a stream over the reference's bins."""
    long = unpivot(stream.withWatermark(ts, lateness), columns, [ts]).filter(
        F.col("value").isNotNull()
    )
    counted = (
        long.join(F.broadcast(limits.select("feature", "lo", "hi").distinct()), "feature")
        .groupBy(F.window(ts, window).alias("_w"), "feature", _bin(bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_cur"))
    )
    return counted.select(F.col("_w.end").alias("ts"), "feature", "bin", "n_cur")


def window_drift(counts: DataFrame, reference: DataFrame, bins: int = N_BINS) -> DataFrame:
    """PSI and Jensen-Shannon distance per window and feature, from counts only."""
    windows = counts.select("ts", "feature").distinct()
    cells = (
        windows.join(reference.select("feature", "bin", "n_ref"), "feature")
        .join(counts, ["ts", "feature", "bin"], "left")
        .fillna(0, ["n_cur"])
    )
    totals = cells.groupBy("ts", "feature").agg(
        F.sum("n_ref").alias("_ref"), F.sum("n_cur").alias("_cur")
    )
    k = bins + 2
    ref = (F.col("n_ref") + 1) / (F.col("_ref") + k)
    cur = (F.col("n_cur") + 1) / (F.col("_cur") + k)
    p = (F.col("n_ref") / F.col("_ref") + DENSITY_SMOOTHING) / (1 + DENSITY_SMOOTHING * k)
    q = (F.col("n_cur") / F.col("_cur") + DENSITY_SMOOTHING) / (1 + DENSITY_SMOOTHING * k)
    middle = (p + q) / 2
    js = F.sum((p * F.log(p / middle) + q * F.log(q / middle)) / 2)
    return (
        cells.join(totals, ["ts", "feature"])
        .groupBy("ts", "feature")
        .agg(
            F.sum("n_cur").alias("n_cur"),
            F.sum((cur - ref) * F.log(cur / ref)).alias("psi"),
            F.sqrt(F.greatest(js, F.lit(0.0))).alias("js_distance"),
        )
    )
