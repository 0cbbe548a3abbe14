"""Summaries of benchmark and load-test requests.

Four percentile definitions exist in this package and are not interchangeable:
nearest rank rounded half to even and floor index (here), linear interpolation
(profiles, load gate) and bucket interpolation (series).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.order_stats import FLOOR_INDEX, NEAREST_EVEN, exact_quantiles
from driftline.functions.scalars import join_on_keys


def percentile_nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float]
) -> DataFrame:
    """``p_<percent>`` per group: the item at index round-half-even(p/100*(n-1))."""
    found = exact_quantiles(df, keys, value, [p / 100 for p in percents], NEAREST_EVEN)
    return found.select(
        *keys, "n", *[F.col("q")[i].alias(f"p_{p:g}") for i, p in enumerate(percents)]
    )


def p95_floor_index(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and the item at index floor(0.95*n), rounded to 4 places."""
    p95 = exact_quantiles(df, keys, value, [0.95], FLOOR_INDEX)
    mean = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return join_on_keys(p95, mean, keys).select(
        *keys, "n", F.round("mean", 4).alias("mean"), F.round(F.col("q")[0], 4).alias("p95")
    )


def benchmark_summary(results: DataFrame, walls: DataFrame, level: str = "concurrency") -> DataFrame:
    """One row per level; failed requests count as errors and nowhere else.

    ``results``: level, ttft_s, total_s, output_tokens, ok. ``walls``: level and
    wall_s, the wall-clock time of the level.
    """
    ok = F.col("ok")
    tokens = F.col("output_tokens")
    rate = F.when((F.col("total_s") > 0) & (tokens > 0), tokens / F.col("total_s"))
    counted = results.groupBy(level).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(ok).alias("ok"),
        F.count_if(~ok).alias("errors"),
        F.coalesce(F.sum(F.when(ok, tokens)), F.lit(0)).alias("total_output_tokens"),
    )
    long = results.filter(ok).select(
        level,
        F.inline(
            F.array(
                F.struct(F.lit("ttft").alias("metric"), F.col("ttft_s").cast("double").alias("v")),
                F.struct(F.lit("latency").alias("metric"), F.col("total_s").cast("double").alias("v")),
                F.struct(F.lit("rate").alias("metric"), rate.cast("double").alias("v")),
            )
        ),
    )
    quantiles = exact_quantiles(long, [level, "metric"], "v", [0.5, 0.95], NEAREST_EVEN)

    def pick(metric: str, i: int) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("q")[i]))

    wide = quantiles.groupBy(level).agg(
        pick("ttft", 0).alias("ttft_p50"),
        pick("ttft", 1).alias("ttft_p95"),
        pick("latency", 0).alias("latency_p50"),
        pick("latency", 1).alias("latency_p95"),
        pick("rate", 0).alias("rate_p50"),
    )

    def rounded(c: str, digits: int) -> Column:
        return F.round(F.coalesce(F.col(c), F.lit(0.0)), digits)

    wall = F.col("wall_s")
    joined = join_on_keys(counted, wide, [level], "left")
    return (
        join_on_keys(joined, walls.select(level, "wall_s"), [level], "left")
        .select(
            level,
            "requests",
            "ok",
            "errors",
            rounded("ttft_p50", 3).alias("ttft_p50_s"),
            rounded("ttft_p95", 3).alias("ttft_p95_s"),
            rounded("latency_p50", 3).alias("latency_p50_s"),
            rounded("latency_p95", 3).alias("latency_p95_s"),
            rounded("rate_p50", 1).alias("per_request_tokens_per_s_median"),
            F.when(wall > 0, F.round(F.col("total_output_tokens") / wall, 1))
            .otherwise(0.0)
            .alias("aggregate_tokens_per_s"),
            "total_output_tokens",
            F.round("wall_s", 1).alias("wall_clock_s"),
        )
    )


def cost_per_mtok(tokens_per_s: Column, hourly_usd: float) -> Column:
    """Dollars per million output tokens; 0 without throughput."""
    millions_per_hour = tokens_per_s * 3600 / 1_000_000
    return F.when(tokens_per_s > 0, F.round(F.lit(hourly_usd) / millions_per_hour, 3)).otherwise(0.0)


def first_errors(
    results: DataFrame, level: str, order: str, error: str = "error", length: int | None = None
) -> DataFrame:
    """The first error text per level; ``length`` cuts it, as the report of a session does."""
    first = F.min_by(error, order)
    return (
        results.filter(F.col(error).isNotNull() & (F.col(error) != ""))
        .groupBy(level)
        .agg((first if length is None else F.substring(first, 1, length)).alias("first_error"))
    )


# Fixed value: column heads of the report table.
REPORT_HEADER = (
    "| conc | ok/err | TTFT p50 | TTFT p95 | e2e p50 | e2e p95 "
    "| tok/s per-req | tok/s aggregate | $/Mtok |"
)


def report_lines(summary: DataFrame, hourly_usd: float, level: str = "concurrency") -> DataFrame:
    """``(level, line)``: the summary as table lines, one per level."""
    text = lambda c: F.col(c).cast("string")
    cells = [
        text(level),
        F.concat(text("ok"), F.lit("/"), text("errors")),
        *[
            F.concat(text(c), F.lit("s"))
            for c in ("ttft_p50_s", "ttft_p95_s", "latency_p50_s", "latency_p95_s")
        ],
        text("per_request_tokens_per_s_median"),
        text("aggregate_tokens_per_s"),
        cost_per_mtok(F.col("aggregate_tokens_per_s"), hourly_usd).cast("string"),
    ]
    return summary.select(
        level, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")
    )
