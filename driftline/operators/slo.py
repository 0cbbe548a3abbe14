"""Service-level objectives: error ratios, burn rates, budget, multi-window alerts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import join_on_keys, matches, ratio
from driftline.operators.series import buckets, dense, record, trailing_sums

MINUTE, HOUR, DAY = 60, 3600, 86_400

# Step, windows and burn factors of the multi-window alerts.
STEP = 5 * MINUTE
WINDOWS = {
    "5m": 5 * MINUTE,
    "30m": 30 * MINUTE,
    "1h": HOUR,
    "2h": 2 * HOUR,
    "6h": 6 * HOUR,
    "1d": DAY,
    "3d": 3 * DAY,
}
PERIOD = 30 * DAY
PAGE = ((14.4, "5m", "1h"), (6.0, "30m", "6h"))
TICKET = ((3.0, "2h", "1d"), (1.0, "6h", "3d"))


@dataclass(frozen=True)
class Objective:
    name: str
    objective: float

    @property
    def budget(self) -> float:
        return 1.0 - self.objective


# The objectives in use.
AVAILABILITY = Objective("requests-availability", 0.999)
LATENCY = Objective("requests-latency", 0.99)
PIPELINE_SUCCESS = Objective("workflow-success", 0.95)
LATENCY_SECONDS = 0.5


def bad_status(status: Column) -> Column:
    """Availability: everything but 2xx is bad."""
    return ~matches(status.cast("string"), "2..")


def too_slow(seconds: Column, limit: float = LATENCY_SECONDS) -> Column:
    return seconds > limit


def failed_run(status: Column) -> Column:
    return status == "Failed"


def request_buckets(
    df: DataFrame, is_bad: Column, labels: Sequence[str], ts: str = "ts", step: int = STEP
) -> DataFrame:
    """Requests and bad requests per (labels, step): the only pass over raw rows."""
    return buckets(
        df, labels, ts, step, bad=F.count_if(is_bad), total=F.count(F.lit(1))
    )


def error_ratios(
    counted: DataFrame,
    labels: Sequence[str],
    step: int = STEP,
    windows: dict[str, int] = WINDOWS,
    period: int = PERIOD,
) -> DataFrame:
    """``ratio_<w>`` for every window, and ``ratio_period``, at every step.

    The period ratio is the mean of the shortest window's ratios, so that busy
    and quiet steps weigh the same; steps without requests have no ratio. All
    windows share one sort.
    """
    seen = max(period, *windows.values())
    full = dense(record(counted, "requests"), labels, step, seen)
    shortest = min(windows, key=windows.get)
    sums = {}
    for name, seconds in windows.items():
        sums[f"_bad_{name}"] = (F.col("bad"), seconds // step)
        sums[f"_all_{name}"] = (F.col("total"), seconds // step)
    summed = trailing_sums(full, labels, sums).withColumns(
        {f"ratio_{w}": ratio(F.col(f"_bad_{w}"), F.col(f"_all_{w}")) for w in windows}
    )
    base = F.col(f"ratio_{shortest}")
    steps = period // step
    return (
        trailing_sums(
            summed.drop(*sums),
            labels,
            {"_ratios": (base, steps), "_known": (base.isNotNull().cast("long"), steps)},
        )
        .withColumn("ratio_period", ratio(F.col("_ratios"), F.col("_known")))
        .drop("_ratios", "_known")
    )


def burn(ratios: DataFrame, objectives: DataFrame, on: Sequence[str], current: str = "5m") -> DataFrame:
    """Adds current and period burn rate and the budget left.

    ``objectives`` holds one row per SLO with its ``objective``.
    """
    budget = 1 - F.col("objective")
    return join_on_keys(ratios, objectives, on).withColumns(
        {
            "budget": budget,
            "current_burn_rate": F.col(f"ratio_{current}") / budget,
            "period_burn_rate": F.col("ratio_period") / budget,
            "budget_remaining": 1 - F.col("ratio_period") / budget,
        }
    )


def _any_pair(pairs: Sequence[tuple[float, str, str]], budget: Column) -> Column:
    hit = F.lit(False)
    for factor, short, long in pairs:
        limit = F.lit(factor) * budget
        hit = hit | ((F.col(f"ratio_{short}") > limit) & (F.col(f"ratio_{long}") > limit))
    return F.coalesce(hit, F.lit(False))


def burn_alerts(
    burned: DataFrame,
    page: Sequence[tuple[float, str, str]] = PAGE,
    ticket: Sequence[tuple[float, str, str]] = TICKET,
) -> DataFrame:
    """Adds ``page`` and ``ticket``: both windows of a pair burn faster than its factor."""
    return burned.withColumns(
        {"page": _any_pair(page, F.col("budget")), "ticket": _any_pair(ticket, F.col("budget"))}
    )
