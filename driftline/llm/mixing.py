"""Mixing sources to target weights, exact to the word.

Sources ordered by code point (null last) weigh 5, 2, 1 and so on again, and
share ``share`` times all words. A target stops at ``most`` times its source's
words; what is above is shared out again by weight until none is above (the
level at which that settles is computed at once from the sources in the order
in which they reach their limit). Within a source the documents get hash-random
keys, are sorted by them, and a running sum of their words decides: every
document is taken as often as the whole source fits into the target, and the
first documents by key once more, up to the word at which the budget is spent.

The keys' leading digits cut a source into ranges of about ``range_rows`` rows.
A document's place is the sum of the ranges before its own (a small table) plus
a running sum inside its range, so that a source with most of the rows is as
many tasks as it has ranges. Keys depend on the document alone: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.tables import write

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
RANGE_ROWS = 5_000


def word_count(text: Column | str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) per source.

    Works on one row per source in one task. Sources without words get the target 0.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    limit = F.lit(most) * F.col("source_size")
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", limit)
    # In this order sources reach their limits as the level per weight rises.
    filling = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    # The level holds from the first source that it leaves below its limit; later ones are lower.
    below = F.col("level") * F.col("weight") <= F.col("limit")
    settled = F.max(F.when(below, F.col("level"))).over(everything)
    rows = rows.withColumn("settled", settled)
    return rows.select(
        "source",
        "source_size",
        "weight",
        F.coalesce(F.least(F.col("settled") * F.col("weight"), F.col("limit")), F.lit(0.0)).alias("target"),
    )


def random_key(id_column: str = "doc_id", text_column: str = "text", seed: str = SEED) -> Column:
    """40 random bits from a document's id (without one: its text), the same in every run."""
    text = F.coalesce(F.col(id_column).cast("string"), F.col(text_column), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), text)), 1, 10), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: str = SEED,
    range_rows: int = RANGE_ROWS,
    carry: str | None = None,
) -> DataFrame:
    """(id, text_hash, source, size, source_size, target, taken[, carry]) per row of ``docs``.

    ``taken`` counts words, repeats included: whole copies, and for the document
    at the cut its first words. The sum per source is its target rounded down.
    Null texts and texts without words have the size 0 and are never taken; null
    sources form a source; rows that share an id are ordered by their text's
    hash, and equal rows stand next to each other. A column ``carry`` comes back
    beside its own row's decision, so that equal rows need no join to tell them
    apart; rows with equal texts are then ordered by its hash. An empty table gives
    an empty one.
    """
    carried = [carry] if carry else []
    whole_rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"),
        random_key(id_column, text_column, seed).alias("key"),
        F.xxhash64(text_column).alias("text_hash"),
        *carried,
    )
    # Carried rows are read again below instead of being written twice.
    slim = write(whole_rows.drop(*carried), "sizes")
    sizes = slim.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    # A number for every source, so that windows and joins deal the rows out by the same keys, without nulls.
    goals = write(
        targets(sizes, weights, share, most)
        .join(sizes.select(F.col("source").alias("s"), "n_rows"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("number", F.monotonically_increasing_id()),
        "targets",
    )
    goals = goals.select(
        F.col("source").alias("goal_source"),
        "number",
        "source_size",
        "target",
        F.ceil(F.col("n_rows") / range_rows).alias("n_ranges"),
    )
    # One row per source: Spark broadcasts it while it is small.
    def placed_in_ranges(rows: DataFrame) -> DataFrame:
        return rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn(
            "range", F.floor(F.col("key") * F.col("n_ranges") / F.lit(1 << 40)).cast("long")
        )

    ranges = placed_in_ranges(slim).groupBy("number", "range").agg(F.sum("size").alias("range_size"))
    earlier = W.partitionBy("number").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = write(
        ranges.select(
            "number", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start")
        ),
        "starts",
    )
    rows = placed_in_ranges(whole_rows if carry else slim)
    order = ["key", "doc_id", "text_hash", *map(F.xxhash64, carried)]
    inside = W.partitionBy("number", "range").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.join(starts, ["number", "range"])
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - whole * F.col("source_size")
    again = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("start") - F.col("inside")))
    return placed.select(
        F.col("doc_id").alias(id_column),
        "text_hash",
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + again).cast("long").alias("taken"),
        *carried,
    )
