"""Cost and resource roll-ups over billing and usage tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.scalars import ratio
from driftline.session import materialise

# Hours per month (GPU costs use 24*30), budget alarm shares.
HOURS_PER_MONTH = 730
GPU_HOURS_PER_MONTH = 24 * 30
BUDGET_SHARES = (0.5, 0.8, 1.0)
GIB = 1024**3


def hourly_and_monthly(prices: DataFrame, by: Sequence[str], price: str = "hourly_usd") -> DataFrame:
    """Hourly and monthly cost by labels (none: the total)."""
    return prices.groupBy(*by).agg(F.sum(price).alias("hourly_usd")).withColumn(
        "monthly_usd", F.col("hourly_usd") * HOURS_PER_MONTH
    )


def gpu_monthly(devices: DataFrame, by: Sequence[str], price: str = "gpu_hourly_usd") -> DataFrame:
    """Monthly GPU cost and mean utilisation as a share."""
    return devices.groupBy(*by).agg(
        (F.sum(price) * GPU_HOURS_PER_MONTH).alias("gpu_monthly_usd"),
        (F.avg("gpu_util_pct") / 100).alias("gpu_util"),
    )


def efficiency(usage: DataFrame, by: Sequence[str], used: str, available: str) -> DataFrame:
    """Used over available: the ratio of the sums."""
    return usage.groupBy(*by).agg(ratio(F.sum(used), F.sum(available)).alias("efficiency"))


def overprovisioning_cost(
    usage: DataFrame, nodes: DataFrame, requested: str, used: str, price: str, by: str = "namespace"
) -> DataFrame:
    """Sum of (request - usage) * price of the node, by namespace.

    Usage is summed per (namespace, node) before it meets the prices, so the
    join moves one row per pair however many pods there are.
    """
    gap = usage.groupBy(by, "node").agg(F.sum(F.col(requested) - F.col(used)).alias("_gap"))
    return (
        gap.join(nodes.select("node", F.col(price).alias("_price")), "node")
        .groupBy(by)
        .agg(F.sum(F.col("_gap") * F.col("_price")).alias("waste_usd"))
    )


def daily_cost(
    billing: DataFrame, first: Column, last: Column, day: str = "day", service: str = "service"
) -> DataFrame:
    """Three cost measures per day and service over [first, last)."""
    return (
        billing.filter((F.col(day) >= first) & (F.col(day) < last))
        .groupBy(day, service)
        .agg(
            F.sum("unblended").alias("unblended"),
            F.sum("blended").alias("blended"),
            F.sum("usage").alias("usage"),
        )
    )


def monthly_cost_of(billing: DataFrame, services: Sequence[str]) -> DataFrame:
    """Monthly cost of a list of services."""
    return (
        billing.filter(F.col("service").isin(*services))
        .groupBy(F.date_trunc("month", "day").cast("date").alias("month"), "service")
        .agg(F.sum("unblended").alias("unblended"))
    )


def pods_by_namespace(pods: DataFrame) -> DataFrame:
    """Each pod's requests beside its namespace's pod count.

    One row per pod instead of one list per namespace: a namespace may hold any
    number of pods.
    """
    counts = materialise(
        pods.groupBy("namespace").agg(F.count(F.lit(1)).alias("pod_count")), "pod-counts"
    )
    return pods.join(counts, "namespace").select(
        "namespace", "pod_count", "pod", "cpu_request", "memory_request"
    )


def budget_crossings(
    spend: DataFrame,
    budgets: DataFrame,
    by: Sequence[str],
    day: str = "day",
    cost: str = "cost",
    shares: Sequence[float] = BUDGET_SHARES,
) -> DataFrame:
    """``(labels, share, day, spent)``: the first day on which spend reaches a share of the budget.

    Spend is first summed per day; the running sum is over days.
    """
    per_day = spend.groupBy(*by, day).agg(F.sum(cost).alias("_cost"))
    running = per_day.withColumn("spent", F.sum("_cost").over(W.partitionBy(*by).orderBy(day)))
    levels = F.array(*[F.lit(float(s)) for s in shares])
    reached = (
        running.join(budgets.select(*by, "budget"), list(by))
        .withColumn("share", F.explode(levels))
        .filter(F.col("spent") >= F.col("share") * F.col("budget"))
    )
    return reached.groupBy(*by, "share").agg(
        F.min(day).alias(day), F.min_by("spent", day).alias("spent")
    )


def usage_ratio(
    usage: DataFrame, limits: DataFrame, by: Sequence[str], used: str, limit: str
) -> DataFrame:
    """Usage over limit by labels; labels without a limit give no row."""
    return (
        usage.groupBy(*by)
        .agg(F.sum(used).alias("used"))
        .join(limits.groupBy(*by).agg(F.sum(limit).alias("limit")), list(by))
        .withColumn("ratio", ratio(F.col("used"), F.col("limit")))
    )


def gpu_rollup(devices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean utilisation, memory share, temperature and power."""
    return devices.groupBy(*by).agg(
        F.avg("gpu_util_pct").alias("util_pct"),
        F.avg(ratio(F.col("mem_used"), F.col("mem_used") + F.col("mem_free")) * 100).alias(
            "memory_pct"
        ),
        F.avg("temperature").alias("temperature"),
        F.avg("power").alias("power"),
        F.sum("mem_used").alias("mem_used"),
        F.sum("mem_free").alias("mem_free"),
    )
