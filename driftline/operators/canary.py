"""Canary analysis: measurements, verdicts, canary against stable, load gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.order_stats import LINEAR, exact_quantiles
from driftline.functions.scalars import floor_at, ratio
from driftline.operators.series import cumulative_counts, hold, or_default, quantile_of_columns
from driftline.session import materialise

# Measurement grid (seconds), trailing window, and metric gates.
INITIAL_DELAY, INTERVAL, COUNT, WINDOW = 60, 60, 5, 120
MIN_DENOMINATOR = 1e-10

# Fixed value: message of a failed run (metric, failures, limit).
FAILED_TEXT = 'Metric "%s" assessed Failed due to failed (%d) > failureLimit (%d)'


@dataclass(frozen=True)
class Gate:
    metric: str
    success: str  # SQL over ``value``
    failure_limit: int


GATES = (
    Gate("success-rate", "value >= 0.95", 2),
    Gate("latency-p95", "value <= 500", 2),
    Gate("error-rate", "value < 0.05", 1),
)


def measurement_grid(
    runs: DataFrame,
    start: str = "started_at",
    initial: int = INITIAL_DELAY,
    interval: int = INTERVAL,
    count: int = COUNT,
) -> DataFrame:
    """One row per run and measurement, ``at`` the measuring instant."""
    at = F.timestamp_micros(
        F.unix_micros(start) + (F.lit(initial) + F.col("measurement").cast("long") * interval) * 1_000_000
    )
    return runs.withColumn(
        "measurement", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    ).withColumn("at", at)


def measure(
    grid: DataFrame,
    requests: DataFrame,
    keys: Sequence[str],
    is_ok: Column,
    latency: str,
    bounds: Sequence[float],
    run: Sequence[str],
    window: int = WINDOW,
    ts: str = "ts",
) -> DataFrame:
    """Success rate, P95 and error rate over the window before each measurement.

    Requests meet measurements on (keys, time bucket as long as the window); a
    measurement asks for two buckets, a request sits in one. Without requests
    the success rate is 0, the others are 0, and ``no_traffic`` is set.
    """
    span = window * 1_000_000
    slot = lambda us: F.floor(us / F.lit(span)).cast("long")
    at = F.unix_micros("at")
    # The grid is written, so that its size is known: while it is small it is
    # broadcast and the requests stay where they are.
    grid = materialise(
        grid.select(*run, *[k for k in keys if k not in run], "measurement", "at"), "grid"
    )
    wanted = grid.withColumn(
        "_slot", F.explode(F.array_distinct(F.array(slot(at - span), slot(at))))
    )
    seen = requests.select(
        *keys,
        F.unix_micros(ts).alias("_us"),
        slot(F.unix_micros(ts)).alias("_slot"),
        is_ok.alias("_ok"),
        F.col(latency).alias("_latency"),
    )
    inside = (F.col("_us") > at - span) & (F.col("_us") <= at)
    met = seen.join(wanted, [*keys, "_slot"]).filter(inside)
    identity = [*run, "measurement", "at"]
    counted = met.groupBy(*identity).agg(
        F.count_if("_ok").alias("_ok"),
        F.count(F.lit(1)).alias("_all"),
        *[c.alias(n) for n, c in cumulative_counts(F.col("_latency"), bounds).items()],
    )
    full = grid.select(*identity).join(counted, identity, "left")
    total = or_default(F.col("_all"), 0)
    ok = or_default(F.col("_ok"), 0)
    below = floor_at(total.cast("double"), MIN_DENOMINATOR)
    return full.select(
        *identity,
        (ok / below).alias("success-rate"),
        or_default(quantile_of_columns(0.95, bounds), 0.0).alias("latency-p95"),
        ((total - ok) / below).alias("error-rate"),
        (total == 0).alias("no_traffic"),
    )


def measurements(
    measured: DataFrame, run: Sequence[str], gates: Sequence[Gate] = GATES
) -> DataFrame:
    """Long form with the phase of every measurement and the metric's failures so far.

    The run ends at the first instant at which a metric has more failures than
    its limit; later measurements are not taken.
    """
    long = measured.select(
        *run,
        "measurement",
        "at",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(g.metric).alias("metric"),
                        F.col(f"`{g.metric}`").alias("value"),
                        F.lit(g.failure_limit).alias("failure_limit"),
                    )
                    for g in gates
                ]
            )
        ),
    )
    passes = F.lit(False)
    for g in gates:
        passes = F.when(F.col("metric") == g.metric, F.expr(g.success)).otherwise(passes)
    failed = (~F.coalesce(passes, F.lit(False))).cast("int")
    # count * gates rows per run from here on.
    so_far = W.partitionBy(*run, "metric").orderBy("measurement")
    whole = W.partitionBy(*run)
    return (
        long.withColumn("phase", F.when(failed == 0, "Successful").otherwise("Failed"))
        .withColumn("failures", F.sum(failed).over(so_far))
        .withColumn(
            "_end",
            F.min(F.when(F.col("failures") > F.col("failure_limit"), F.col("measurement"))).over(whole),
        )
        .filter(F.col("_end").isNull() | (F.col("measurement") <= F.col("_end")))
        .drop("_end")
    )


def metric_verdicts(taken: DataFrame, run: Sequence[str]) -> DataFrame:
    """Per run and metric: measurements taken, failures, phase."""
    return taken.groupBy(*run, "metric", "failure_limit").agg(
        F.count(F.lit(1)).alias("count"),
        F.max("failures").alias("failed"),
        F.when(F.max("failures") > F.first("failure_limit"), "Failed")
        .otherwise("Successful")
        .alias("phase"),
    )


def run_verdicts(verdicts: DataFrame, run: Sequence[str], champion: Column | None = None) -> DataFrame:
    """Per run: phase, the message of the failing metric that is first by name, and the action.

    ``champion`` is an aggregate over the run that tells where to roll back to.
    """
    failed = F.col("phase") == "Failed"
    message = F.min(
        F.when(
            failed,
            F.format_string(
                FAILED_TEXT,
                F.col("metric"),
                F.col("failed"),
                F.col("failure_limit"),
            ),
        )
    )
    known = (champion if champion is not None else F.lit(None)).isNotNull()
    any_failed = F.max(failed)
    return verdicts.groupBy(*run).agg(
        F.count(F.lit(1)).alias("metrics"),
        F.count_if(failed).alias("failed_metrics"),
        F.when(any_failed, "Failed").otherwise("Successful").alias("phase"),
        message.alias("message"),
        F.when(any_failed, F.when(known, "rollback").otherwise("fail"))
        .otherwise("keep")
        .alias("action"),
    )


# --- canary against stable ----------------------------------------------------

# Allowed growth of the canary over the stable version.
ERROR_FACTOR, LATENCY_FACTOR = 1.5, 1.3
TRAFFIC_STEPS = {10: 25, 25: 50, 50: 100}


def canary_vs_stable(
    requests: DataFrame,
    labels: Sequence[str],
    is_canary: Column,
    is_bad: Column,
    latency: str,
    bounds: Sequence[float],
    bucket: Column,
) -> DataFrame:
    """Error ratio and P95 of both versions per (labels, bucket), in one aggregation."""
    sides = {"canary": is_canary, "stable": ~is_canary}
    aggregates = []
    for side, mine in sides.items():
        aggregates += [
            F.count_if(mine & is_bad).alias(f"{side}_bad"),
            F.count_if(mine).alias(f"{side}_all"),
        ]
        value = F.when(mine, F.col(latency))
        aggregates += [
            c.alias(f"{side}_{n}") for n, c in cumulative_counts(value, bounds).items()
        ]
    counted = requests.groupBy(*labels, bucket.alias("ts")).agg(*aggregates)
    return counted.select(
        *labels,
        "ts",
        *[ratio(F.col(f"{s}_bad"), F.col(f"{s}_all")).alias(f"{s}_error_ratio") for s in sides],
        *[quantile_of_columns(0.95, bounds, f"{s}_le_").alias(f"{s}_p95") for s in sides],
    ).withColumns(
        {
            "worse_errors": F.col("canary_error_ratio") > F.col("stable_error_ratio") * ERROR_FACTOR,
            "worse_latency": F.col("canary_p95") > F.col("stable_p95") * LATENCY_FACTOR,
        }
    )


def canary_alerts(
    compared: DataFrame, labels: Sequence[str], hold_seconds: int, step_seconds: int
) -> DataFrame:
    """Held alerts of :func:`canary_vs_stable`: errors are critical, latency a warning."""
    parts = [
        hold(compared, labels, F.col(flag), hold_seconds, step_seconds).select(
            F.lit(name).alias("alertname"),
            F.lit(severity).alias("severity"),
            *labels,
            "ts",
            "active_since",
            "state",
        )
        for name, flag, severity in (
            ("CanaryHigherErrorRate", "worse_errors", "critical"),
            ("CanaryHigherLatency", "worse_latency", "warning"),
        )
    ]
    return parts[0].unionByName(parts[1])


def next_traffic(current: Column) -> Column:
    """The next traffic share: 10, 25, 50, 100; unknown shares give null."""
    out = F.when(current == 100, 100)
    for share, following in TRAFFIC_STEPS.items():
        out = out.when(current == share, following)
    return out


def version_comparison(
    requests: DataFrame,
    labels: Sequence[str],
    is_ok: Column,
    latency: str,
    bounds: Sequence[float],
    bucket: Column,
) -> DataFrame:
    """Success rate and P95 per version (a label) and bucket."""
    counted = requests.groupBy(*labels, bucket.alias("ts")).agg(
        F.count_if(is_ok).alias("ok"),
        F.count(F.lit(1)).alias("requests"),
        *[c.alias(n) for n, c in cumulative_counts(F.col(latency), bounds).items()],
    )
    return counted.select(
        *labels,
        "ts",
        "requests",
        ratio(F.col("ok"), F.col("requests")).alias("success_rate"),
        quantile_of_columns(0.95, bounds).alias("p95"),
    )


# --- load gate ----------------------------------------------------------------

# Milliseconds and shares of the load gate.
LOAD_LIMITS = (
    ("p95", "value < 500"),
    ("p99", "value < 1000"),
    ("failed_share", "value < 0.05"),
    ("check_error_share", "value < 0.01"),
    ("inference_p95", "value < 400"),
)


def load_gate(
    requests: DataFrame,
    latency: str,
    failed: Column,
    check_error: Column,
    is_inference: Column,
    limits: Sequence[tuple[str, str]] = LOAD_LIMITS,
) -> DataFrame:
    """``(metric, value, passed)`` of a load test: exact interpolated percentiles and shares."""
    kinds = F.array_compact(
        F.array(F.lit("all"), F.when(is_inference, F.lit("inference")))
    )
    by_kind = requests.select(F.explode(kinds).alias("kind"), F.col(latency).alias("v"))
    quantiles = exact_quantiles(by_kind, ["kind"], "v", [0.95, 0.99], LINEAR).select(
        F.inline(
            F.when(
                F.col("kind") == "all",
                F.array(
                    F.struct(F.lit("p95").alias("metric"), F.col("q")[0].alias("value")),
                    F.struct(F.lit("p99").alias("metric"), F.col("q")[1].alias("value")),
                ),
            ).otherwise(
                F.array(
                    F.struct(F.lit("inference_p95").alias("metric"), F.col("q")[0].alias("value"))
                )
            )
        )
    )
    shares = requests.agg(
        F.array(
            F.struct(
                F.lit("failed_share").alias("metric"),
                F.avg(failed.cast("double")).alias("value"),
            ),
            F.struct(
                F.lit("check_error_share").alias("metric"),
                F.avg(check_error.cast("double")).alias("value"),
            ),
        ).alias("a")
    ).select(F.inline("a"))
    passed = F.lit(False)
    for metric, condition in limits:
        passed = F.when(F.col("metric") == metric, F.expr(condition)).otherwise(passed)
    return quantiles.unionAll(shares).withColumn("passed", F.coalesce(passed, F.lit(False)))
