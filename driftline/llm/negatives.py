"""Hard negatives by Strassen products of anchor and candidate tiles.

Anchors and candidates are gathered into tiles. An anchor tile meets every group
of candidate tiles; each product is computed by Strassen's recursion on 64-bit
integers, the operands padded with zeros to even sides. Integer additions and
products are exact modulo 2**64, so a product is exact wherever its scores fit a
long; tiles that may leave that range are multiplied by the same recursion on
unbounded integers.

1. *Positives.* From every product the first rows of the anchor's own label are
   kept as a short sorted list; lists of an anchor merge group by group.
2. *Windows.* The products are formed again. Each (anchor, positive) keeps the
   first rows of other labels whose scores lie between ``low`` and ``high`` per
   cent of the positive's; these lists merge in the same way.

A list has at most ``k`` entries, and at most ``FAN_IN`` lists meet in a merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import write
from driftline.llm.topk import whole_components

SCALE = 256
K = 5
LOW, HIGH = 80, 100
SHARD_ROWS, ANCHOR_ROWS = 4096, 512
#: Candidate tiles that meet an anchor tile in one task: their matrices are held there.
GROUP_TILES = 32
FAN_IN = 32
#: Strassen's recursion ends where a side is at most so long.
LEAF = 32
LIMITS = np.iinfo(np.int64)


# --- exact products -----------------------------------------------------------


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype != object:
        largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
        # Sums that doubles hold exactly need no integer product; abs() of the least long is negative.
        if 0 <= largest < 2**53 and a.min(initial=0) > LIMITS.min and b.min(initial=0) > LIMITS.min:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(matrix: np.ndarray) -> np.ndarray:
    """The matrix with a row and a column of zeros where a side is odd."""
    m, n = matrix.shape
    if m % 2 == 0 and n % 2 == 0:
        return matrix
    out = np.zeros((m + m % 2, n + n % 2), matrix.dtype)
    out[:m, :n] = matrix
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 (modulo 2**64) or object (unbounded) integers with seven products a level."""
    m, k = a.shape
    n = b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    out = np.empty((2 * i, 2 * h), a.dtype)
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out[:i, :h] = p1 + p4 - p5 + p7
    p3 = strassen(a11, b12 - b22, leaf)
    out[:i, h:] = p3 + p5
    p2 = strassen(a21 + a22, b11, leaf)
    out[i:, :h] = p2 + p4
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    out[i:, h:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of two integer matrices' rows; a score beyond a long becomes its limit."""
    if anchors.dtype != object and rows.dtype != object:
        reach = np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0)
        if reach * np.abs(rows.astype(np.float64)).max(initial=0) < 2.0**62:
            return strassen(anchors, rows.T)
    found = strassen(anchors.astype(object), rows.astype(object).T)
    return np.clip(found, LIMITS.min, LIMITS.max).astype(np.int64)


# --- short sorted lists -------------------------------------------------------


def best_first(values: np.ndarray) -> np.ndarray:
    """Columns of each row by falling value, equal ones in order. (~x falls as x rises, without overflow.)"""
    return np.argsort(~values, axis=1, kind="stable")


def positives_of(found, anchor_ids, anchor_labels, ids, labels, k):
    """(row, score, id) of the first ``k`` candidates of each anchor's own label, its own id left out."""
    out = [[], [], []]
    for label in np.unique(anchor_labels):
        mine, same = np.flatnonzero(anchor_labels == label), np.flatnonzero(labels == label)
        if not len(same):
            continue
        part = found[np.ix_(mine, same)]
        order = best_first(part)
        other = ids[same][order] != anchor_ids[mine][:, None]
        keep = other & (np.cumsum(other, axis=1) <= k)
        row, place = np.nonzero(keep)
        column = order[row, place]
        for held, new in zip(out, (mine[row], part[row, column], ids[same][column]), strict=True):
            held.append(new)
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def window_of(found, anchor_ids, anchor_labels, ids, labels, asked, k, low, high):
    """(entry of ``asked``, score, id): the first ``k`` candidates of other labels in each window.

    ``asked`` is (row of the anchor, score of the positive), one entry per pair.
    """
    # Candidates that are not asked for go behind all others, by a second key.
    barred = (labels[None, :] == anchor_labels[:, None]) | (ids[None, :] == anchor_ids[:, None])
    order = best_first(found)
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(barred, order, 1), axis=1, kind="stable"), 1)
    sorted_scores = np.take_along_axis(found, order, 1)
    usable = (~barred).sum(axis=1)
    out = [[], [], []]
    for entry, (row, score) in enumerate(asked):
        # low * p <= 100 * n <= high * p in unbounded integers, as bounds of n.
        least, most = -((-low * score) // 100), (high * score) // 100
        if least > most or least > LIMITS.max or most < LIMITS.min:
            continue
        line = ~sorted_scores[row, : usable[row]]
        start = int(np.searchsorted(line, ~min(most, LIMITS.max), "left"))
        stop = int(np.searchsorted(line, ~max(least, LIMITS.min), "right"))
        columns = order[row, start : min(stop, start + k)]
        out[0].append(np.full(len(columns), entry))
        out[1].append(found[row, columns])
        out[2].append(ids[columns])
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


# --- tiles --------------------------------------------------------------------

TILE = "tile long, width int, ids binary, labels binary, matrix binary"


def usable_rows(vectors: DataFrame, id_column: str, vector_column: str, label: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    vector = F.col(vector_column)
    # NaN is greater than infinity here.
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.select(
        F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"),
        vector.cast("array<double>").alias("vector"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite)


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """Tiles of at most ``size`` rows of one length, ascending by id inside."""

    def work(batches):
        waiting: dict[int, list] = {}
        made = 0
        part = TaskContext.get().partitionId()

        def tile(width, held):
            nonlocal made
            order = np.argsort(held[0], kind="stable")
            made += 1
            columns = [held[0][order], held[1][order], held[2][order]]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made - 1], pa.int64()), pa.array([width], pa.int32()),
                 *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]],
                ["tile", "width", "ids", "labels", "matrix"],
            )

        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = batch.column(2)
            edges = vectors.offsets.to_numpy()
            values, lengths = vectors.values.to_numpy(), np.diff(edges)
            for width in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == width)
                matrix = values[edges[here][:, None] + np.arange(width)]
                new = [ids[here], labels[here], matrix]
                held = waiting.get(width)
                held = new if held is None else [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
                while len(held[0]) >= size:
                    yield tile(width, [c[:size] for c in held])
                    held = [c[size:] for c in held]
                waiting[width] = held
        for width, held in waiting.items():
            if len(held[0]):
                yield tile(width, held)

    return rows.select("id", "label", "vector").mapInArrow(work, TILE)


def _met(anchors: DataFrame, shards: DataFrame, groups: int) -> DataFrame:
    """Every anchor tile beside every candidate tile of its length, group by group.

    The anchor tiles are the streamed side, so that one tile's pairs of a group
    follow each other and their lists merge before they leave the task.
    """
    asked = anchors.select(
        *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "width"],
        "width", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    return asked.join(shards, ["group", "width"])


def _numbers(batch, name, i, kind=np.int64):
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[i].as_py(), kind)


def _pairs(batches, scale):
    """(anchor tile's number, its ids, its labels, batch, place, ids, labels, scores) of every pair of tiles."""
    held: tuple = (None, None)
    for batch in batches:
        for i in range(batch.num_rows):
            width = batch.column(batch.schema.get_field_index("width"))[i].as_py()
            tile = batch.column(batch.schema.get_field_index("a_tile"))[i].as_py()
            if held[0] != tile:
                held = tile, whole_components(_numbers(batch, "a_matrix", i, np.float64).reshape(-1, width), scale)
            rows = whole_components(_numbers(batch, "matrix", i, np.float64).reshape(-1, width), scale)
            yield (
                tile, *[_numbers(batch, c, i) for c in ("a_ids", "a_labels")], batch, i,
                *[_numbers(batch, c, i) for c in ("ids", "labels")], scores(held[1], rows),
            )


ENTRY = "array<struct<worse:long,id:long>>"
LIST = f"tile long, entry long, anchor_id long, part long, best {ENTRY}"


class _Lists:
    """The short lists of one anchor tile: columns (entry, score, id), cut to ``k`` an entry."""

    def __init__(self, tile, k):
        self.tile, self.k, self.held = tile, k, [np.empty(0, np.int64)] * 3

    def add(self, entry, score, ids):
        entry, score, ids = (np.concatenate(c) for c in zip(self.held, (entry, score, ids), strict=True))
        order = np.lexsort((ids, ~score, entry))
        entry, score, ids = entry[order], score[order], ids[order]
        starts = np.flatnonzero(np.diff(entry, prepend=-1))
        rank = np.arange(len(entry)) - np.repeat(starts, np.diff([*starts, len(entry)]))
        self.held = [c[rank < self.k] for c in (entry, score, ids)]

    def batch(self, anchor_of, part):
        entry, score, ids = self.held
        starts = np.flatnonzero(np.diff(entry, prepend=-1))
        names = entry[starts]
        entries = pa.StructArray.from_arrays([pa.array(~score), pa.array(ids)], names=["worse", "id"])
        lists = pa.ListArray.from_arrays(pa.array([*starts, len(entry)], pa.int32()), entries)
        columns = [np.full(len(names), self.tile), names, anchor_of[names], np.full(len(names), part)]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns], lists], ["tile", "entry", "anchor_id", "part", "best"]
        )


def _merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """One list per (tile, entry): at most about ``FAN_IN`` lists meet at each level."""
    lists = write(lists, "lists")
    last = False
    while not last:
        parts = -(-parts // FAN_IN)
        last = parts == 1
        lists = (
            lists.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(parts)))
            .groupBy("tile", "entry", "anchor_id", "part")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        )
    return lists.drop("part")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    positives: int = K,
    negatives: int = K,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    group_tiles: int = GROUP_TILES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``; a score is the integer inner product
    with the anchor, and higher ones come first, ties by the smaller id. An
    anchor's positives are its first other rows of its label; each pair's
    negatives are the first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.

    Rows without id, label or vector, or with a null or non-finite component
    take no part; nor do vectors of another length than the anchor's. ``is_anchor``
    and ``label`` are expressions over ``vectors``. Rows with the anchor's id are
    not its candidates. Repeated candidates count each; a repeated anchor row is
    answered each time. A score beyond a long becomes its limit, where ties go by
    id. Empty tables, anchors without positives and empty windows give no rows.
    """
    label = F.col("label") if label is None else label
    chosen = vectors.withColumn("_anchor", is_anchor)
    rows = usable_rows(chosen, id_column, vector_column, label)
    shards = write(tiles(rows, shard_rows), "shards")
    asked = usable_rows(chosen.filter("_anchor"), id_column, vector_column, label)
    # Dealt anew, so that few anchors among many rows still make full tiles.
    asked = asked.repartition(max(1, -(-asked.count() // anchor_rows)))
    anchors = write(tiles(asked, anchor_rows), "anchors")
    n_shards = shards.count()
    width = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_shards // group_tiles), min(n_shards, width))
    shards = shards.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))

    def find_positives(batches):
        part = TaskContext.get().partitionId()
        lists, anchor_of = None, None
        for tile, a_ids, a_labels, _, _, ids, labels, found in _pairs(batches, scale):
            if lists is None or lists.tile != tile:
                if lists is not None:
                    yield lists.batch(anchor_of, part)
                lists, anchor_of = _Lists(tile, positives), a_ids
            lists.add(*positives_of(found, a_ids, a_labels, ids, labels, positives))
        if lists is not None:
            yield lists.batch(anchor_of, part)

    near = _merged(_met(anchors, shards, groups).mapInArrow(find_positives, LIST), groups, positives)
    # One row per anchor tile: (row, score, id) of all its pairs, at most rows x positives.
    pairs = near.select("tile", F.col("entry").alias("row"), F.explode("best").alias("p")).select(
        "tile", F.struct("row", "p.worse", F.col("p.id").alias("positive_id")).alias("pair")
    )
    pairs = pairs.groupBy("tile").agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
    pairs = write(pairs, "pairs")

    def find_windows(batches):
        part = TaskContext.get().partitionId()
        lists, anchor_of, asked_for = None, None, None
        for tile, a_ids, a_labels, batch, i, ids, labels, found in _pairs(batches, scale):
            if lists is None or lists.tile != tile:
                if lists is not None:
                    yield lists.batch(anchor_of, part)
                pair = batch.column(batch.schema.get_field_index("a_pairs"))[i].as_py()
                asked_for = [(p["row"], ~p["worse"]) for p in pair]
                lists = _Lists(tile, negatives)
                anchor_of = a_ids[np.array([row for row, _ in asked_for], np.int64)]
            lists.add(*window_of(found, a_ids, a_labels, ids, labels, asked_for, negatives, low, high))
        if lists is not None:
            yield lists.batch(anchor_of, part)

    known = write(anchors.join(pairs, "tile"), "known")
    found = _merged(_met(known, shards, groups).mapInArrow(find_windows, LIST), groups, negatives)
    named = pairs.select("tile", F.posexplode("pairs").alias("entry", "pair"))
    return (
        found.join(named.withColumn("entry", F.col("entry").cast("long")), ["tile", "entry"])
        .select("anchor_id", "pair.*", F.posexplode("best").alias("place", "n"))
        .select(
            "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"),
            F.col("n.id").alias("negative_id"), F.bitwise_not("worse").alias("positive_score"),
            F.bitwise_not("n.worse").alias("negative_score"),
        )
    )
