"""Alert rules over metric tables, routing, grouping and inhibition.

A metric table has one row per (labels, ts). Which column a rule reads is part
of the rule, so the same rule runs over any table that carries the column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.scalars import join_on_keys, known_hash, ratio
from driftline.operators.series import hold

MINUTE, HOUR, DAY = 60, 3600, 86_400


@dataclass(frozen=True)
class AlertRule:
    """Fires while ``condition`` (SQL over the metric table) has held for ``hold`` seconds."""

    name: str
    condition: str
    hold: int
    severity: str
    needs: tuple[str, ...] = ()


# Thresholds, hold times and severities of the standard rules.
STANDARD_RULES = (
    AlertRule("HighLatency", "p95_seconds > 1", 5 * MINUTE, "warning", ("p95_seconds",)),
    AlertRule("HighP99Latency", "p99_seconds > 1", 5 * MINUTE, "warning", ("p99_seconds",)),
    AlertRule("HighErrorRate", "error_ratio > 0.05", 5 * MINUTE, "critical", ("error_ratio",)),
    AlertRule("Restarts", "restarts_1h > 3", 5 * MINUTE, "warning", ("restarts_1h",)),
    AlertRule("ServiceDown", "up = 0", 2 * MINUTE, "critical", ("up",)),
    AlertRule(
        "WorkflowFailures", "failed_ratio_1h > 0.1", 15 * MINUTE, "warning", ("failed_ratio_1h",)
    ),
    AlertRule("LowGpuUtilisation", "gpu_util < 20", 30 * MINUTE, "info", ("gpu_util",)),
    AlertRule("HighGpuUtilisation", "gpu_util > 90", 10 * MINUTE, "warning", ("gpu_util",)),
    AlertRule("HighGpuMemory", "gpu_memory_pct > 90", 5 * MINUTE, "warning", ("gpu_memory_pct",)),
    AlertRule(
        "NotReady",
        "replicas_available < replicas_wanted",
        5 * MINUTE,
        "warning",
        ("replicas_available", "replicas_wanted"),
    ),
    AlertRule("HighVolumeUsage", "volume_pct > 85", 15 * MINUTE, "warning", ("volume_pct",)),
    AlertRule(
        "CertificateExpires", "cert_seconds_left < 604800", HOUR, "warning", ("cert_seconds_left",)
    ),
    AlertRule(
        "PolicyViolations", "policy_failures_1h > 0", 5 * MINUTE, "info", ("policy_failures_1h",)
    ),
    AlertRule("AccuracyDrop", "accuracy_drop > 0.05", 15 * MINUTE, "critical", ("accuracy_drop",)),
    AlertRule("VersionGap", "accuracy_gap > 0.1", 30 * MINUTE, "info", ("accuracy_gap",)),
    AlertRule(
        "ThroughputDrop", "throughput_drop > 0.3", 10 * MINUTE, "warning", ("throughput_drop",)
    ),
    AlertRule("LatencySpike", "latency_growth > 0.5", 5 * MINUTE, "warning", ("latency_growth",)),
    AlertRule("LowConfidence", "confidence < 0.7", 15 * MINUTE, "warning", ("confidence",)),
    AlertRule("QueueDepth", "in_flight > 100", 5 * MINUTE, "warning", ("in_flight",)),
    AlertRule("CostAnomaly", "cost_growth > 0.5", HOUR, "warning", ("cost_growth",)),
    AlertRule("HighMemory", "memory_ratio > 0.9", 5 * MINUTE, "warning", ("memory_ratio",)),
    AlertRule(
        "NodeMemoryLow", "node_memory_free_ratio < 0.1", 5 * MINUTE, "critical",
        ("node_memory_free_ratio",),
    ),
    AlertRule(
        "DatabaseConnections", "db_connections > 80", 5 * MINUTE, "warning", ("db_connections",)
    ),
    AlertRule("PodPending", "pending = 1", 30 * MINUTE, "warning", ("pending",)),
    AlertRule("ScalerErrors", "scaler_errors_5m > 0", 5 * MINUTE, "warning", ("scaler_errors_5m",)),
    AlertRule("WorkflowFailed", "failed_runs > 0", 0, "warning", ("failed_runs",)),
)


# --- metrics the rules compare ------------------------------------------------


def baseline_drop(baseline: Column, current: Column) -> Column:
    """Absolute loss against a baseline (accuracy)."""
    return baseline - current


def baseline_growth(baseline: Column, current: Column) -> Column:
    """Relative growth against a baseline (latency, cost)."""
    return ratio(current - baseline, baseline)


def baseline_shrink(baseline: Column, current: Column) -> Column:
    """Relative loss against a baseline (throughput)."""
    return ratio(baseline - current, baseline)


def version_gap(champion: Column, challenger: Column) -> Column:
    return F.abs(champion - challenger)


def memory_pct_of_total(used: Column, total: Column) -> Column:
    return ratio(used, total) * 100


def memory_pct_of_used_and_free(used: Column, free: Column) -> Column:
    return ratio(used, used + free) * 100


def seconds_left(expires: Column, as_of: Column) -> Column:
    return (F.unix_micros(expires) - F.unix_micros(as_of)) / F.lit(1_000_000.0)


# --- evaluation ---------------------------------------------------------------


def applicable(rules: Sequence[AlertRule], df: DataFrame) -> list[AlertRule]:
    """The rules whose columns the table carries."""
    return [r for r in rules if all(c in df.columns for c in r.needs)]


def evaluate(
    metrics: DataFrame,
    rules: Sequence[AlertRule],
    labels: Sequence[str],
    step_seconds: int,
    ts: str = "ts",
) -> DataFrame:
    """``(alertname, severity, labels, ts, active_since, state)`` of all rules in one pass.

    Every row is tested against all rules at once; only hits go on, keyed by
    rule and series.
    """
    hits = F.array(
        *[
            F.struct(
                F.lit(r.name).alias("alertname"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.hold).cast("long").alias("hold"),
                F.coalesce(F.expr(r.condition), F.lit(False)).alias("hit"),
            )
            for r in rules
        ]
    )
    active = metrics.select(
        *labels, ts, F.inline(F.filter(hits, lambda h: h["hit"]))
    )
    held = hold(active, ["alertname", *labels], F.col("hit"), 0, step_seconds, ts)
    age = F.unix_micros(ts) - F.unix_micros("active_since")
    return held.withColumn(
        "state", F.when(age >= F.col("hold") * 1_000_000, "firing").otherwise("pending")
    ).drop("hit", "hold")


def alert(
    df: DataFrame,
    name: str,
    predicate: Column,
    labels: Sequence[str],
    hold_seconds: int,
    severity: str,
    step_seconds: int,
    ts: str = "ts",
) -> DataFrame:
    """A single rule given as a Column."""
    return hold(df, labels, predicate, hold_seconds, step_seconds, ts).select(
        F.lit(name).alias("alertname"),
        F.lit(severity).alias("severity"),
        *labels,
        ts,
        "active_since",
        "state",
    )


# --- routing ------------------------------------------------------------------

# Receivers, and the grouping times in seconds.
SILENT_RECEIVER = "null"
WATCHDOG = "Watchdog"
RECEIVERS = {"critical": "critical-alerts", "warning": "warning-alerts"}
GROUP_BY = ("alertname", "namespace", "severity")
GROUP_WAIT, GROUP_INTERVAL, REPEAT_INTERVAL = 30, 5 * MINUTE, 4 * HOUR


def receiver(alertname: Column, severity: Column) -> Column:
    """First matching route: the watchdog by name, then by severity."""
    out = F.when(alertname == WATCHDOG, SILENT_RECEIVER)
    for level, name in RECEIVERS.items():
        out = out.when(severity == level, name)
    return out.otherwise(SILENT_RECEIVER)


def inhibit(
    firing: DataFrame, equal: Sequence[str] = ("alertname", "namespace"), ts: str = "ts"
) -> DataFrame:
    """Drops warnings at instants at which a critical alert with equal labels fires."""
    critical = firing.filter(F.col("severity") == "critical").select(*equal, ts).distinct()
    warnings = firing.filter(F.col("severity") == "warning")
    others = firing.filter(F.coalesce(F.col("severity"), F.lit("")) != "warning")
    return others.unionByName(join_on_keys(warnings, critical, [*equal, ts], "left_anti"))


def notifications(
    firing: DataFrame,
    by: Sequence[str] = GROUP_BY,
    step_seconds: int = 60,
    wait: int = GROUP_WAIT,
    interval: int = GROUP_INTERVAL,
    repeat: int = REPEAT_INTERVAL,
    fingerprint: Sequence[str] = (),
    ts: str = "ts",
) -> DataFrame:
    """``(group, sent_at, alerts, reason)``: what a grouping, throttling router sends.

    An alert is told apart by the columns of ``fingerprint`` (by default all but
    the time); rows that repeat one at an instant count once.

    A group starts when one of its alerts fires after a step without any. It is
    flushed ``wait`` seconds later and then every ``interval``. A flush sends if
    it is the first, if the set of alerts changed, or if ``repeat`` has passed
    since the last send.
    """
    by = list(by)
    ident = known_hash(fingerprint or [c for c in firing.columns if c != ts])
    alerts = firing.select(*by, ts, ident.alias("_ident")).distinct()
    # Two sums over the set: different sets have different ones but for chance.
    spread = F.xxhash64("_ident", F.lit(1))
    instants = alerts.groupBy(*by, ts).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.struct(F.bit_xor("_ident"), F.bit_xor(spread), F.count(F.lit(1))).alias("set"),
    )
    # From here on: one row per group and evaluation instant, or fewer.
    order = W.partitionBy(*by).orderBy(F.unix_micros(ts))
    us = F.unix_micros(ts)
    previous = F.lag(us).over(order)
    started = instants.withColumn(
        "_s", F.when(previous.isNull() | (us - previous > step_seconds * 1_000_000), us)
    ).withColumn("started", F.last("_s", ignorenulls=True).over(order))
    age = (us - F.col("started")) / 1_000_000 - wait
    flush = F.when(age <= 0, 0).otherwise(F.ceil(age / interval)).cast("long")
    flushes = started.groupBy(*by, "started", flush.alias("flush")).agg(
        F.max_by(F.struct("alerts", "set"), us).alias("last")
    )
    runs = W.partitionBy(*by, "started").orderBy("flush")
    changed = F.lag("last.set").over(runs).isNull() | (
        F.lag("last.set").over(runs) != F.col("last.set")
    )
    marked = flushes.withColumn("_run", F.when(changed, F.col("flush"))).withColumn(
        "_run", F.last("_run", ignorenulls=True).over(runs)
    )
    every = max(1, -(-repeat // interval))
    since = F.col("flush") - F.col("_run")
    return marked.filter(since % every == 0).select(
        *by,
        F.timestamp_micros(
            F.col("started") + (F.lit(wait).cast("long") + F.col("flush") * interval) * 1_000_000
        ).alias("sent_at"),
        F.col("last.alerts").alias("alerts"),
        F.when(F.col("flush") == 0, "new")
        .when(since == 0, "changed")
        .otherwise("repeat")
        .alias("reason"),
    )
