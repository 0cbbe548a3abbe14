"""Packing documents into sequences as a cutting-stock problem.

A document's ids (with the closing id) are cut into pieces of ``length`` and one
remainder. The pieces are counted by length, in steps of ``step`` ids: at most
``length / step`` counts, however many documents there are. The least number of
sequences for those counts is a linear program over patterns (how many pieces of
each length fill a sequence). It is solved by column generation: the master
program's dual prices go into a knapsack over the sequence's length, whose best
filling enters as the next pattern until none pays. Patterns are used a whole
number of times; what rounding leaves over (a few sequences per pattern) is
filled first-fit by falling length. Then pieces are ranked within their length,
and a piece's rank alone tells its sequence.

Sequences waste at most ``step - 1`` ids per piece, besides those left over.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.llm.tables import write
from driftline.llm.tokens import tokenizer, vocabulary_path
from driftline.llm.words import text_slices

LENGTH = 2048
STEP = 8
END_ID = 1
#: Rows ranked by one task.
RANKED_ROWS = 5_000
ROUNDS = 3_000


def pieces(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of every document's pieces."""

    def work(batches):
        words = tokenizer(path)
        for batch in batches:
            for rows, buffer, offsets in text_slices(batch):
                ids, bounds = words.encode_slice(buffer, offsets)
                sizes = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                counts = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), counts)
                first = np.cumsum(counts) - counts
                start = (np.arange(len(doc)) - first[doc]) * length
                size = np.minimum(sizes[doc] - start, length)
                at = bounds[doc] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                columns = [
                    rows.column("id").take(pa.array(doc)),
                    *[pa.array(x, pa.int64()) for x in (start, size, crc, sizes[doc])],
                ]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    edges = pa.array(np.append(at, bounds[-1]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long"
    return slim.mapInArrow(work, schema + (", ids array<int>" if with_ids else ""))


def _best_filling(prices: np.ndarray, units: int) -> np.ndarray:
    """How many pieces of 1, 2, ... units fill ``units`` units at the highest price."""
    best, took = np.zeros(units + 1), np.zeros(units + 1, int)
    for room in range(1, units + 1):
        # A piece of i units leaves room - i.
        gains = prices[: min(room, len(prices))] + best[room - 1 :: -1][: len(prices)]
        i = len(gains) - 1 - int(np.argmax(gains[::-1]))  # of equals the longest
        if gains[i] > best[room - 1]:
            best[room], took[room] = gains[i], i + 1
        else:
            best[room] = best[room - 1]
    filling, room = np.zeros(len(prices), int), units
    while room > 0:
        if took[room]:
            filling[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return filling


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan on a few hundred rows; a threaded library call can stall on a busy machine."""
    n = len(matrix)
    rows = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.argmax(np.abs(rows[i:, i])))
        if pivot != i:
            rows[[i, pivot]] = rows[[pivot, i]]
        rows[i] /= rows[i, i]
        factors = rows[:, i].copy()
        factors[i] = 0.0
        rows -= np.multiply.outer(factors, rows[i])
    return rows[:, n:]


def cutting_patterns(counts: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every piece is used once.

    ``counts[i]`` pieces have ``i + 1`` units; a sequence has ``len(counts)``.
    Columns are those of a first-fit packing and whatever the knapsack adds. The
    result is right, if not the best, wherever the rounds end.
    """
    units = len(counts)
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    need = counts[present].astype(float)
    known = np.array([filling[present] for filling, _ in _first_fit(counts)], float).T
    # At first each sequence holds pieces of one length only.
    basis = np.diag(units // (present + 1)).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    for round_ in range(rounds):
        if round_ % 100 == 99:
            inverse = _inverse(basis)
        prices = inverse.sum(axis=0)  # every sequence costs 1
        worth = (prices[:, None] * known).sum(axis=0)
        column = known[:, int(np.argmax(worth))]
        if worth.max() <= 1 + 1e-7:
            priced = np.zeros(units)
            priced[present] = prices
            column = _best_filling(priced, units)[present].astype(float)
            if prices @ column <= 1 + 1e-7:
                break
            known = np.column_stack([known, column])
        # Sums of products: matrices this small are not worth BLAS threads.
        entering = (inverse * column).sum(axis=1)
        amounts = np.maximum((inverse * need).sum(axis=1), 0)
        ratios = np.full(len(present), np.inf)
        usable = entering > 1e-9
        ratios[usable] = amounts[usable] / entering[usable]
        leaves = int(np.argmin(ratios))
        basis[:, leaves] = column
        row = inverse[leaves] / entering[leaves]
        inverse -= np.multiply.outer(entering, row)
        inverse[leaves] = row
    used = np.floor(np.maximum((_inverse(basis) * need).sum(axis=1), 0) + 1e-6).astype(int)
    plan, left = [], counts.astype(int).copy()
    for chosen, times in zip(basis.T, used.tolist(), strict=True):
        column = np.zeros(units, int)
        column[present] = np.rint(chosen).astype(int)
        times = min([times, *(left[i] // column[i] for i in np.flatnonzero(column))])
        if times > 0:
            plan.append((column, int(times)))
            left = left - column * times
    return plan + _first_fit(left)


def _first_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Fills sequences with the longest pieces that still fit; equal fillings count as one pattern."""
    plan, left = [], left.copy()
    while left.any():
        filling, room = np.zeros(len(left), int), len(left)
        for i in np.flatnonzero(left)[::-1]:
            filling[i] = min(left[i], room // (i + 1))
            room -= filling[i] * (i + 1)
        times = min(left[i] // filling[i] for i in np.flatnonzero(filling))
        plan.append((filling, int(times)))
        left -= filling * times
    return plan


def _places(plan, units: int):
    """Per length: ranks from ``edges[i]`` on go to sequences from ``first[i]``, ``times[i]`` in turn."""
    next_rank, sequence, rows = np.zeros(units, np.int64), 0, []
    for column, times in plan:
        for i in np.flatnonzero(column):
            rows.append((i + 1, next_rank[i], sequence, times))
            next_rank[i] += column[i] * times
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(
    docs: DataFrame,
    path: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    step: int = STEP,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece.

    ``path`` is the vocabulary's file. A null or empty text is the closing id
    alone. Rows that repeat an id, or have none, are packed each for itself.
    Only the counts per length pass through the driver. An empty table gives an
    empty one; further columns of ``docs`` are not looked at.
    """
    cut = write(pieces(docs, path or vocabulary_path(), id_column, text_column, length), "pieces")
    units = -(-length // step)
    binned = cut.withColumn("units", F.ceil(F.col("length") / step).cast("long"))
    counts = np.zeros(units, np.int64)
    for row in binned.groupBy("units").count().collect():  # at most one row per length
        counts[row["units"] - 1] = row["count"]
    places = _places(cutting_patterns(counts), units)
    # Lengths with many pieces are ranked in several parts.
    parts = F.element_at(F.array(*[F.lit(int(max(1, -(-c // ranked_rows)))) for c in counts]), F.col("units").cast("int"))
    order = ("id", "start", "ids_crc32", "doc_tokens")
    salted = binned.withColumn("part", F.pmod(F.xxhash64(*order), parts))
    sizes = salted.groupBy("units", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("units").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(
        F.col("units").alias("u"), F.col("part").alias("p"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    inside = W.partitionBy("units", "part").orderBy(*order)
    ranked = (
        salted.withColumn("row", F.row_number().over(inside) - 1)
        .join(before, (F.col("units") == F.col("u")) & (F.col("part") == F.col("p")))
        .withColumn("rank", F.col("row") + F.col("before"))
    )
    edges = places[:, 0] * (1 << 40) + places[:, 1]

    def sequence_of(unit: pa.Array, rank: pa.Array) -> pa.Array:
        rank = rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(edges, unit.to_numpy(zero_copy_only=False) * (1 << 40) + rank, "right") - 1
        _, first_rank, first, times = places[at].T
        return pa.array(first + (rank - first_rank) % times, pa.int64())

    placed = ranked.withColumn("sequence_id", F.arrow_udf(sequence_of, "long")(F.col("units"), F.col("rank")))
    placed = write(placed.select(*cut.columns, "sequence_id"), "placed")
    ahead = (
        W.partitionBy("sequence_id")
        .orderBy(F.desc("length"), *order)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return placed.select(
        F.col("id").alias(id_column),
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, pad_id: int = 0,
              id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, padded to ``length``.

    A sequence whose length is a power of two is left as it is.
    """
    cut = pieces(docs, path or vocabulary_path(), id_column, text_column, length, with_ids=True)
    keys = ["id", "start", "ids_crc32", "doc_tokens"]
    placed = packed.withColumnRenamed(id_column, "id").select(*keys, "sequence_id", "offset")
    # Equal pieces (of repeated rows) may change places: each is numbered on both sides.
    same = W.partitionBy(*keys).orderBy("start")
    cut = cut.withColumn("copy", F.row_number().over(same))
    placed = placed.withColumn("copy", F.row_number().over(same))
    filled = (
        placed.withColumn("id", F.coalesce("id", F.lit(-1)))
        .join(cut.withColumn("id", F.coalesce("id", F.lit(-1))), [*keys, "copy"])
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
    )
    size = F.size("ids")
    power = F.bit_count(size) == 1
    pad = F.array_repeat(F.lit(pad_id), F.when(power, 0).otherwise(length - size))
    return filled.withColumn("ids", F.concat("ids", pad))
