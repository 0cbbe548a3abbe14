"""Order-dependent work on groups of any size.

A window over a key puts all rows of the key into one task. That is fine for
most keys. Keys with more than ``hot_rows`` rows are cut by row rank in their
order into chunks of about ``chunk_rows`` rows; what a chunk needs from the
earlier ones (a last row, a total) is carried to it, so that every chunk can be
worked on alone with the same result. Only one summary row per (key, chunk) ever
meets the others of its key. Without hot keys there are no chunks.

Chunks are equal in rows, not in time: rows that crowd on one instant, or are
equal altogether, are split like any others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions.scalars import join_on_keys
from driftline.session import materialise

HOT_ROWS = 4_000_000
CHUNK_ROWS = 250_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``(keys, _rows)`` of every hot key; None without any.

    Written, so that its size is known to the joins that use it.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialise(sizes.filter(F.col("_rows") > hot_rows), "hot-keys")
    return None if hot.isEmpty() else hot


def _chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame, chunk_rows: int
) -> DataFrame:
    """Adds ``_chunk``, ascending in a hot key's order; keys that are not hot have the chunk 0.

    Only hot rows are dealt out by range. They are written before, so that the
    place by which equal rows are told apart is the same when a task runs again,
    and after, so that every reader sees the same chunks.
    """
    marked = join_on_keys(df, hot, keys, "left")
    cold = marked.filter(F.col("_rows").isNull()).drop("_rows").withColumn("_chunk", F.lit(0))
    crowded = materialise(marked.filter(F.col("_rows").isNotNull()).drop("_rows"), "hot-rows")
    parts = max(2, -(-hot.agg(F.sum("_rows")).first()[0] // chunk_rows))
    ranged = (
        crowded.withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys, *order, "_place")
        .withColumn("_chunk", F.spark_partition_id() + 1)
        .drop("_place")
    )
    return cold.unionByName(materialise(ranged, "hot-chunks"))


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``prev_<v>``: the value of the key's previous row by (ts, tie)."""
    keys, order = list(keys), [ts, *tie]
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        whole = W.partitionBy(*keys).orderBy(*order)  # at most hot_rows rows
        return df.withColumns({f"prev_{v}": F.lag(v).over(whole) for v in values})
    chunked = _chunked(df, keys, order, hot, chunk_rows)
    last = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    carried = (
        last.withColumn("_to", F.lead("_chunk").over(W.partitionBy(*keys).orderBy("_chunk")))
        .filter(F.col("_to").isNotNull())
        .select(
            *keys,
            F.col("_to").alias("_chunk"),
            F.lit(True).alias("_carried"),
            *[F.col(f"_last.{v}").alias(v) for v in values],
        )
    )
    rows = chunked.withColumn("_carried", F.lit(False)).unionByName(
        carried, allowMissingColumns=True
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(F.desc("_carried"), *order)
    return (
        rows.withColumns({f"prev_{v}": F.lag(v).over(inside) for v in values})
        .filter(~F.col("_carried"))
        .drop("_carried", "_chunk")
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: Sequence[str] = (),
    name: str = "row",
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds the 1-based position of a row in its key's (ts, tie) order."""
    keys = list(keys)
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        whole = W.partitionBy(*keys).orderBy(ts, *tie)  # at most hot_rows rows
        return df.withColumn(name, F.row_number().over(whole).cast("long"))
    chunked = _chunked(df, keys, [ts, *tie], hot, chunk_rows)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(ts, *tie)
    numbered = chunked.withColumn(name, F.row_number().over(inside))
    return (
        join_on_keys(numbered, offsets, [*keys, "_chunk"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_chunk", "_offset")
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    xors: Mapping[str, str | Column] | None = None,
    hot_rows: int | None = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds the running sums (and running exclusive-ors) of a key's rows in ``order``, the row included.

    ``order`` should tell a key's rows apart. The result's columns map to the
    summed ones; null counts as 0. Without ``hot_rows`` no key is held to be hot.
    """
    keys, kinds = list(keys), {**{n: F.sum for n in sums}, **{n: F.bit_xor for n in xors or {}}}
    given = {n: F.col(c) if isinstance(c, str) else c for n, c in {**sums, **(xors or {})}.items()}
    df = df.withColumns({f"_of_{n}": F.coalesce(c, F.lit(0)) for n, c in given.items()})
    helpers = [f"_of_{n}" for n in given]
    hot = None if hot_rows is None else hot_keys(df, keys, hot_rows)
    if hot is None:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({n: kinds[n](f"_of_{n}").over(whole) for n in given}).drop(*helpers)
    chunked = _chunked(df, keys, order, hot, chunk_rows)
    totals = chunked.groupBy(*keys, "_chunk").agg(*[kinds[n](f"_of_{n}").alias(f"_all_{n}") for n in given])
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_chunk",
        *[F.coalesce(kinds[n](f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in given],
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = chunked.withColumns({n: kinds[n](f"_of_{n}").over(inside) for n in given})
    before = {n: F.col(f"_before_{n}") for n in given}
    joined = join_on_keys(here, carried, [*keys, "_chunk"]).withColumns({
        n: F.col(n) + before[n] if n in sums else F.col(n).bitwiseXOR(before[n]) for n in given
    })
    return joined.drop("_chunk", *helpers, *[f"_before_{n}" for n in given])


def latest_before(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    rows_ts: str,
    facts_ts: str,
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds ``fact``: the key's latest row of ``facts`` not after the row's time (null if none).

    An as-of join as one union and one sort per key, or per chunk of a hot key.
    A chunk starts with the last fact of the key's earlier chunks, so it needs
    no other chunk, and no pair of rows is ever formed.
    """
    keys = list(keys)
    known = facts.dropna(subset=[*keys, facts_ts]).select(
        *keys,
        F.col(facts_ts).alias("_at"),
        F.struct(*tie).alias("_tie") if tie else F.lit(0).alias("_tie"),
        F.struct(*[F.col(c) for c in facts.columns]).alias("fact"),
        F.lit(1).alias("_kind"),
    )
    asked = rows.select(
        *keys,
        F.col(rows_ts).alias("_at"),
        F.struct(*[F.col(c) for c in rows.columns]).alias("_row"),
        F.lit(2).alias("_kind"),
    )
    merged = known.unionByName(asked, allowMissingColumns=True)
    hot = hot_keys(merged, keys, hot_rows)
    group = keys
    if hot is not None:
        group = [*keys, "_chunk"]
        merged = _chunked(merged, keys, ["_at", "_kind", "_tie"], hot, chunk_rows)
        merged = merged.unionByName(_carried_facts(merged, keys), allowMissingColumns=True)
    # Order in a group: carried fact, then facts before rows of the same instant.
    order = W.partitionBy(*group).orderBy(
        F.col("_kind") != 0, F.col("_at"), F.col("_kind"), F.col("_tie")
    )
    return (
        merged.withColumn("fact", F.last("fact", ignorenulls=True).over(order))
        .filter(F.col("_kind") == 2)
        .select("_row.*", "fact")
    )


def _carried_facts(merged: DataFrame, keys: list[str]) -> DataFrame:
    """The last earlier fact for every (key, chunk)."""
    last = merged.groupBy(*keys, "_chunk").agg(
        F.max_by("fact", F.when(F.col("_kind") == 1, F.struct("_at", "_tie"))).alias("fact")
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    return (
        last.withColumn("fact", F.last("fact", ignorenulls=True).over(earlier))
        .filter(F.col("fact").isNotNull())
        .select(*keys, "_chunk", F.lit(0).alias("_kind"), "fact")
    )
