"""Exact quantiles of groups of any size.

A group of up to ``limit`` rows is counted by value and ranked by one window. A
larger group is narrowed first: a sketch of the rows gives a short bracket of
values around each wanted rank, a counting pass tells how many rows lie below
and inside it, and this repeats inside the bracket until it is small. Then only
the bracket's values are shuffled and ranked. The counts are exact whatever the
sketch says; a bracket that misses its rank fails the job, it never gives a
wrong value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.scalars import clean_double, join_on_keys
from driftline.session import materialise

LINEAR = "linear"
NEAREST_EVEN = "nearest_even"
FLOOR_INDEX = "floor_index"


def _position(method: str, prob: float, n: Column) -> Column:
    """0-based (fractional for LINEAR) position of a probability among n sorted values."""
    p = F.lit(float(prob))
    if method == LINEAR:
        return p * (n - 1)
    if method == NEAREST_EVEN:
        return F.least(F.greatest(F.bround(p * (n - 1), 0), F.lit(0.0)), (n - 1).cast("double"))
    if method == FLOOR_INDEX:
        return F.least(F.floor(p * n), n - 1).cast("double")
    raise ValueError(f"unknown percentile definition: {method}")


def _inside(v: Column) -> Column:
    return (v >= F.col("_lo")) & (v <= F.col("_hi"))


def _narrow(
    rows: DataFrame, state: DataFrame, keys: list[str], wanted: list[str], limit: int, grid: int
) -> DataFrame:
    """Brackets with more than ``limit`` rows, cut down; the others as they are.

    ``state``: one row per bracket with its keys, _n, _lo, _hi, _below (rows
    below it), _inside (rows in it) and the positions it is to answer.
    """
    bracket = [*keys, "_lo", "_hi"]
    large = (F.col("_inside") > limit) & (F.col("_lo") < F.col("_hi"))
    edges = [i / grid for i in range(grid + 1)]
    sketched = (
        join_on_keys(rows, state.filter(large).select(*bracket), keys)
        .filter(_inside(F.col("_v")))
        .groupBy(*bracket)
        .agg(F.percentile_approx("_v", edges, 4 * grid).alias("_edges"))
    )
    # One row per bracket and position; the sketch's rank error is below 1/(4*grid).
    place = (F.col("_pos") - F.col("_below")) / F.col("_inside") * grid
    low = F.greatest(F.floor(place).cast("int") - 1, F.lit(0))
    high = F.least(F.ceil(place).cast("int") + 1, F.lit(grid))
    positions = F.array(
        *[F.struct(F.lit(c).alias("i"), F.col(c).alias("pos")) for c in wanted]
    )
    narrowed = (
        join_on_keys(state.filter(large), sketched, bracket)
        .select("*", F.inline(F.filter(positions, lambda t: t["pos"].isNotNull())).alias("_i", "_pos"))
        .select(
            *keys,
            "_n",
            "_i",
            "_pos",
            # The outermost edges are the bracket's own, known exactly.
            F.when(low == 0, F.col("_lo")).otherwise(F.get("_edges", low)).alias("_lo"),
            F.when(high == grid, F.col("_hi")).otherwise(F.get("_edges", high)).alias("_hi"),
        )
        .groupBy(*bracket, "_n")
        .agg(*[F.max(F.when(F.col("_i") == c, F.col("_pos"))).alias(c) for c in wanted])
    )
    narrowed = materialise(narrowed, "quantile-brackets")
    counted = (
        join_on_keys(rows, narrowed.select(*bracket), keys)
        .groupBy(*bracket)
        .agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"),
            F.count_if(_inside(F.col("_v"))).alias("_inside"),
        )
    )
    return join_on_keys(narrowed, counted, bracket).unionByName(state.filter(~large))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    method: str = LINEAR,
    limit: int = 2_000_000,
    grid: int = 1024,
) -> DataFrame:
    """One row per group with ``n`` and the array ``q`` of exact quantiles.

    ``method`` is LINEAR (interpolated), NEAREST_EVEN (index rounded half to
    even) or FLOOR_INDEX (index ``floor(p*n)``). Nulls and NaN are left out; a
    group without values gives no row.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("at least one grouping column is needed; unpivot columns to get one")
    rows = df.select(*keys, clean_double(value).alias("_v")).filter(F.col("_v").isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n").alias("n")).first()["n"]
    if largest is None or largest <= limit:
        ranked = _rank_whole_groups(rows, keys, probs, method)
    else:
        ranked = _rank_brackets(rows, sizes, keys, probs, method, limit, grid)
    return _interpolate(ranked, keys, len(probs))


def _rank_whole_groups(
    rows: DataFrame, keys: list[str], probs: Sequence[float], method: str
) -> DataFrame:
    """Every value with the ranks [_start, _end) it covers, and the wanted positions."""
    group = W.partitionBy(*keys)  # at most ``limit`` rows
    n = F.col("_n")
    return (
        rows.groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.sum("_c").over(group.orderBy("_v")))
        .withColumn("_n", F.sum("_c").over(group))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .withColumns({f"_pos{i}": _position(method, p, n) for i, p in enumerate(probs)})
    )


def _large_rows(state: DataFrame, limit: int) -> int:
    """Rows in the brackets that are still to be cut down."""
    large = (F.col("_inside") > limit) & (F.col("_lo") < F.col("_hi"))
    return state.filter(large).agg(F.coalesce(F.sum("_inside"), F.lit(0))).first()[0]


def _rank_brackets(
    rows: DataFrame,
    sizes: DataFrame,
    keys: list[str],
    probs: Sequence[float],
    method: str,
    limit: int,
    grid: int,
) -> DataFrame:
    """As :func:`_rank_whole_groups`, for the values near the wanted positions only."""
    wanted = [f"_pos{i}" for i in range(len(probs))]
    bracket = [*keys, "_lo", "_hi"]
    # Written, so that its size is known: a few groups are then broadcast to the
    # rows, and the rows are not shuffled for this join.
    state = materialise(
        sizes.select(
            *keys,
            "_n",
            F.lit(-math.inf).alias("_lo"),
            F.lit(math.inf).alias("_hi"),
            F.lit(0).cast("long").alias("_below"),
            F.col("_n").alias("_inside"),
            *[_position(method, p, F.col("_n")).alias(c) for p, c in zip(probs, wanted)],
        ),
        "quantile-groups",
    )
    # Until no bracket is large, or the large ones are down to a few heavily repeated values.
    left, before = _large_rows(state, limit), math.inf
    while 0 < left < before:
        before = left
        state = materialise(_narrow(rows, state, keys, wanted, limit, grid), "quantile-state")
        left = _large_rows(state, limit)
    by_value = W.partitionBy(*bracket).orderBy("_v")
    ranked = (
        join_on_keys(rows, state.select(*bracket), keys)
        .filter(_inside(F.col("_v")))
        .groupBy(*bracket, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.sum("_c").over(by_value))
    )
    return (
        join_on_keys(ranked, state.drop("_inside"), bracket)
        .withColumn("_end", F.col("_end") + F.col("_below"))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )


def _interpolate(ranked: DataFrame, keys: list[str], count: int) -> DataFrame:
    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    found = []
    for i in range(count):
        pos = F.col(f"_pos{i}")
        found += [
            at(F.floor(pos)).alias(f"_a{i}"),
            at(F.ceil(pos)).alias(f"_b{i}"),
            F.max(pos).alias(f"_p{i}"),
        ]
    picked = ranked.groupBy(*keys, "_n").agg(*found)
    answers = []
    for i in range(count):
        a, b, pos = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_p{i}")
        missed = F.raise_error(F.lit("a quantile bracket missed its rank")).cast("double")
        answers.append(
            F.when(a.isNull() | b.isNull(), missed)
            .when(a == b, a)
            .otherwise(a + (b - a) * (pos - F.floor(pos)))
        )
    return picked.select(*keys, F.col("_n").alias("n"), F.array(*answers).alias("q"))


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[Column | str] = ()) -> DataFrame:
    """Long form ``(keep..., feature, value)`` of numeric columns; NaN becomes null."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), clean_double(c).alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(pairs))
