"""Error ratios of a stream, kept up to date step by step.

Every step of a series is written with its running totals. A trailing sum is the
total now minus the total one window earlier, so a micro-batch reads the steps one
window before the ones it changes and no others: how long the table has been kept
does not matter. The totals are exact (ratios as decimals of 18 places), so that
they do not drift either.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.scalars import join_on_keys, ratio
from driftline.operators.slo import PERIOD, STEP, WINDOWS
from driftline.session import materialise
from driftline.streaming.tables import BatchWriter, newest

_TOTALS = ("run_bad", "run_all", "run_ratio", "run_known")
_RATIO = "decimal(28,18)"


def _existing(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _day(us):
    return F.floor(us / F.lit(86_400_000_000)).cast("int")


def kept_steps(
    spark: SparkSession, path: str, labels: Sequence[str], spans: Sequence[tuple[int, int]], before: int
) -> DataFrame | None:
    """The newest version, among batches below ``before``, of the steps in some spans of microseconds.

    Only the folders of the spans' days are listed and read. None without any.
    """
    days = sorted({d for lo, hi in spans for d in range(lo // 86_400_000_000, hi // 86_400_000_000 + 1)})
    folders = [f for f in (f"{path}/steps/day={d}" for d in days) if _existing(spark, f)]
    if not folders:
        return None
    rows = spark.read.option("basePath", f"{path}/steps").parquet(*folders).filter(F.col("batch") < before)
    inside = F.lit(False)
    for lo, hi in spans:
        inside = inside | F.col("us").between(lo, hi)
    values = [c for c in rows.columns if c not in (*labels, "us", "batch", "day")]
    latest = rows.filter(inside).groupBy(*labels, "us").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*labels, "us", "v.*")


def live_ratios(
    path: str,
    labels: Sequence[str],
    step: int = STEP,
    windows: dict[str, int] = WINDOWS,
    period: int = PERIOD,
) -> BatchWriter:
    """A writer for the changed buckets of ``monitoring.request_buckets`` (in update mode).

    After each micro-batch :func:`current_ratios` gives what ``slo.error_ratios``
    gives for all buckets so far. A batch that runs again replaces its own rows.
    Late buckets change the steps from theirs on. Labels may be null.
    """
    labels = list(labels)
    wide = step * 1_000_000
    back = {name: seconds * 1_000_000 for name, seconds in windows.items()}
    seen = max(period, *windows.values()) * 1_000_000
    shortest = min(windows, key=windows.get)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = materialise(
            batch.select(*labels, F.unix_micros("ts").alias("us"), "bad", "total"), "slo-changes"
        )
        if changed.isEmpty():
            return
        moved = changed.groupBy(*labels).agg(F.min("us").alias("low"), F.max("us").alias("last"))
        moved = moved.withColumn("end", F.lit(None).cast("long"))
        if _existing(spark, f"{path}/series"):
            earlier = spark.read.parquet(f"{path}/series").filter(F.col("batch") < number)
            latest = earlier.agg(F.max("batch")).first()[0]
            if latest is not None:
                held = earlier.filter(F.col("batch") == latest)
                moved = moved.unionByName(held.select(*labels, F.lit(None).cast("long").alias("low"), "last", "end"))
        series = moved.groupBy(*labels).agg(F.min("low").alias("low"), F.max("last").alias("last"), F.max("end").alias("end"))
        # One row per series; the newest instant of all is one number.
        newest_step = series.agg(F.max("last")).first()[0]
        spans = materialise(
            series.select(
                *labels,
                "last",
                F.least("low", F.col("end") + wide).alias("from"),
                F.least(F.lit(newest_step), F.col("last") + seen).alias("end"),
            ),
            "slo-series",
        )
        due = spans.filter(F.col("from") <= F.col("end"))
        low, high = due.agg(F.min("from"), F.max("end")).first()
        reach = [(low - wide, high)] + [(low - b, high - b) for b in {*back.values(), period * 1_000_000}]
        kept = kept_steps(spark, path, labels, reach, number)

        bounds = due.select(*labels, "from")
        now = changed.withColumn("_new", F.lit(1))
        if kept is not None:
            kept = join_on_keys(kept, bounds, labels)
            old = kept.filter((F.col("us") >= F.col("from")) & F.col("total").isNotNull())
            now = now.unionByName(old.select(*labels, "us", "bad", "total", F.lit(0).alias("_new")))
        now = now.groupBy(*labels, "us").agg(F.max_by(F.struct("bad", "total"), "_new").alias("v"))
        grid = due.select(*labels, F.explode(F.sequence("from", "end", F.lit(wide))).alias("us"))
        rows = join_on_keys(grid, now.select(*labels, "us", "v.*"), [*labels, "us"], "left")
        rows = rows.withColumns({"_due": F.lit(True), **{c: F.lit(None) for c in _TOTALS}})
        if kept is not None:
            before = kept.filter(F.col("us") < F.col("from")).withColumn("_due", F.lit(False))
            rows = before.select(*labels, "us", "bad", "total", "_due", *_TOTALS).unionByName(rows)

        order = W.partitionBy(*labels).orderBy("us")
        so_far = order.rowsBetween(W.unboundedPreceding, 0)

        def total(value, kept_total):
            """The running total: that of the last kept step before, and all due values since."""
            begun = F.last(F.when(~F.col("_due"), F.col(kept_total)), ignorenulls=True).over(so_far)
            added = F.sum(F.when(F.col("_due"), F.coalesce(value, F.lit(0)))).over(so_far)
            return F.coalesce(begun, F.lit(0)) + F.coalesce(added, F.lit(0))

        def grown(name, window):
            """Growth of a running total over a window that ends here."""
            return F.col(name) - F.coalesce(F.last(name).over(order.rangeBetween(-window, -window)), F.lit(0))

        rows = rows.withColumns({"run_bad": total(F.col("bad"), "run_bad"), "run_all": total(F.col("total"), "run_all")})
        rows = rows.withColumns({f"ratio_{w}": ratio(grown("run_bad", b), grown("run_all", b)) for w, b in back.items()})
        wholes = [grown(c, back[shortest]).cast("decimal(20,0)") for c in ("run_bad", "run_all")]
        rows = rows.withColumn("_base", F.try_divide(*wholes).cast(_RATIO))
        base = F.col("_base")
        rows = rows.withColumns(
            {
                "run_ratio": total(base, "run_ratio").cast(_RATIO),
                "run_known": total(base.isNotNull().cast("long"), "run_known"),
            }
        )
        over_period = ratio(grown("run_ratio", period * 1_000_000), grown("run_known", period * 1_000_000))
        rows = rows.withColumn("ratio_period", over_period).filter("_due").drop("_due", "_base")
        (
            rows.withColumns({"day": _day(F.col("us")), "batch": F.lit(number)})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "batch")
            .parquet(f"{path}/steps")
        )
        spans.select(*labels, "last", "end").write.mode("overwrite").parquet(f"{path}/series/batch={number}")

    return write


def current_ratios(
    spark: SparkSession, path: str, labels: Sequence[str], windows: dict[str, int] = WINDOWS
) -> DataFrame:
    """``(labels, ts, bad, total, ratio_<w>, ratio_period)`` of every step, as of the last micro-batch."""
    ratios = [f"ratio_{w}" for w in windows]
    steps = newest(spark, f"{path}/steps", [*labels, "us"])
    return steps.select(*labels, F.timestamp_micros("us").alias("ts"), "bad", "total", *ratios, "ratio_period")
