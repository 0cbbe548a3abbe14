"""Exact top-k search by inner product: tiles, partial selection, tree merge.

Vectors are gathered into shard tiles and query tiles. Every query tile is dealt
to every group of shards and multiplied, as integer matrices, with each shard of
the group; from a product only each query's ``k`` best are kept (ties go to the
smaller id) and merged with those of the group's earlier shards, so that one
list per query and group is written. These lists are then merged ``FAN_IN`` at a
time until one list per query is left, so no task sees more than about
``FAN_IN * k`` entries of a query, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import write

SCALE = 64
K = 20
SHARD_ROWS = 4096
QUERY_ROWS = 1024
#: Shards that a query tile meets in one task, one after the other.
GROUP_SHARDS = 32
FAN_IN = 16


def whole_components(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64, or object where a component does not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x)
    if x.size == 0 or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    flat = [int(s) if np.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel(), x.ravel(), strict=True)]
    return np.array(flat, dtype=object).reshape(x.shape)


def usable_rows(ids: pa.Array, vectors: pa.Array):
    """(ids, matrix of doubles) per vector length; rows with nulls or non-finite components left out."""
    lengths = np.array([len(v) if v is not None else 0 for v in vectors.to_pylist()])
    values = vectors.to_pylist()
    usable = [
        i for i, (key, v) in enumerate(zip(ids.to_pylist(), values, strict=True))
        if key is not None and v and None not in v
    ]
    for length in sorted(set(lengths[usable].tolist())):
        rows = np.array([i for i in usable if lengths[i] == length])
        matrix = np.array([values[i] for i in rows], np.float64)
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            key = np.array(ids.take(pa.array(rows[fine])).to_pylist(), np.int64)
            yield length, key, matrix[fine]


TILE = "tile long, width int, ids binary, matrix binary"


def _tiles(vectors: DataFrame, rows: int) -> DataFrame:
    """Tiles of at most ``rows`` vectors of one length, ascending by id inside."""

    def work(batches):
        waiting: dict[int, list] = {}
        made = 0
        part = TaskContext.get().partitionId()

        def tile(width, ids, matrix):
            nonlocal made
            order = np.argsort(ids, kind="stable")
            made += 1
            return pa.RecordBatch.from_pydict({
                "tile": pa.array([(part << 32) + made - 1], pa.int64()),
                "width": pa.array([width], pa.int32()),
                "ids": pa.array([ids[order].tobytes()], pa.binary()),
                "matrix": pa.array([matrix[order].tobytes()], pa.binary()),
            })

        for batch in batches:
            for width, ids, matrix in usable_rows(batch.column(0), batch.column(1)):
                held = waiting.setdefault(width, [np.empty(0, np.int64), np.empty((0, width))])
                held[0] = np.concatenate([held[0], ids])
                held[1] = np.concatenate([held[1], matrix])
                while len(held[0]) >= rows:
                    yield tile(width, held[0][:rows], held[1][:rows])
                    held[0], held[1] = held[0][rows:], held[1][rows:]
        for width, (ids, matrix) in waiting.items():
            if len(ids):
                yield tile(width, ids, matrix)

    return vectors.mapInArrow(work, TILE)


def best_of_tile(queries, query_ids, shard, shard_ids, k: int):
    """(row of the query, score, id) of each query's ``k`` best in one shard, its own id left out."""
    n = len(shard_ids)
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(shard).max(initial=0)) * shard.shape[1]
    largest = max(largest, 2**53 * (queries.dtype == object or shard.dtype == object))
    if (largest + 1) * 2 * n < 2**53:  # doubles hold a score and a column together
        scores = queries.astype(np.float64) @ shard.astype(np.float64).T
        # Of equal scores the first column, which has the smaller id, counts more.
        ranked = scores * n + np.arange(n - 1, -1, -1.0)
        ranked[query_ids[:, None] == shard_ids[None, :]] = -np.inf
        kept = np.argpartition(-ranked, min(k, n) - 1, axis=1)[:, : min(k, n)]
        row = np.repeat(np.arange(len(queries)), kept.shape[1])
        column = kept.ravel()
        real = np.isfinite(ranked[row, column])
        row, column = row[real], column[real]
        return row, scores[row, column].astype(np.int64), shard_ids[column]
    limits = np.iinfo(np.int64)
    found = []
    for i, query in enumerate(queries.astype(object)):
        scores = shard.astype(object) @ query
        best = sorted((-s, j) for j, s in zip(shard_ids.tolist(), scores, strict=True) if j != query_ids[i])
        found += [(i, min(max(-s, limits.min), limits.max), j) for s, j in best[:k]]
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return tuple(np.array(c, np.int64) for c in columns)


def merged(held, more, k: int):
    """The ``k`` best of two lists (row, score, id) per row, best first."""
    row, score, found = (np.concatenate(c) for c in zip(held, more, strict=True))
    order = np.lexsort((found, ~score, row))
    row, score, found = row[order], score[order], found[order]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(starts, np.diff([*starts, len(row)]))
    return [c[rank < k] for c in (row, score, found)]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): for every row of ``queries`` its ``k`` best rows of ``vectors``.

    Components become ``floor(scale * x)``; scores are their exact inner
    products (a score beyond a long becomes its limit, where ties go by id). Rows
    without id, with a null vector or component or a non-finite one take no part,
    nor do vectors of another length than the query's. Rows with the query's id are
    not its candidates. A repeated query row is answered each time. Empty tables
    give an empty one.
    """
    slim = [F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")]
    shards = write(_tiles(vectors.select(*slim), shard_rows), "shards")
    # Dealt anew, so that few queries among many rows still make full tiles.
    asked = queries.select(*slim).repartition(max(1, -(-queries.count() // query_rows)))
    asked = write(_tiles(asked, query_rows), "queries")
    n_shards = shards.count()
    width = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_shards // GROUP_SHARDS), min(n_shards, width))
    copies = asked.select(
        F.col("tile").alias("query_tile"), "width",
        F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
    )
    dealt = shards.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    # The queries are the streamed side: the pairs of a tile with its group's shards follow each other.
    pairs = copies.join(dealt, ["group", "width"])

    def lists_of(tile, q_ids, held, part):
        row, score, found = held
        edges = np.searchsorted(row, np.arange(len(q_ids) + 1))
        # ``worse`` is the score's complement: ascending order is best first, without overflow.
        entries = pa.StructArray.from_arrays([pa.array(~score), pa.array(found)], names=["worse", "id"])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(q_ids), tile)),
                pa.array(np.arange(len(q_ids))),
                pa.array(q_ids),
                pa.array(np.full(len(q_ids), part)),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), entries),
            ],
            ["query_tile", "query_row", "query_id", "part", "best"],
        )

    def work(batches):
        part = TaskContext.get().partitionId()
        tile, q, q_ids, held = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                pair = {name: batch.column(name)[i] for name in batch.schema.names}
                size = pair["width"].as_py()
                if pair["query_tile"].as_py() != tile:
                    if tile is not None:
                        yield lists_of(tile, q_ids, held, part)
                    tile, held = pair["query_tile"].as_py(), [np.empty(0, np.int64)] * 3
                    q_ids = np.frombuffer(pair["query_ids"].as_py(), np.int64)
                    q = whole_components(np.frombuffer(pair["query_matrix"].as_py()).reshape(-1, size), scale)
                s = whole_components(np.frombuffer(pair["matrix"].as_py()).reshape(-1, size), scale)
                s_ids = np.frombuffer(pair["ids"].as_py(), np.int64)
                held = merged(held, best_of_tile(q, q_ids, s, s_ids, k), k)
        if tile is not None:
            yield lists_of(tile, q_ids, held, part)

    lists = pairs.mapInArrow(
        work,
        "query_tile long, query_row long, query_id long, part long, best array<struct<worse:long,id:long>>",
    )
    lists = write(lists, "lists")
    query = ["query_tile", "query_row", "query_id"]
    left, last = groups, False
    while not last:
        # About FAN_IN lists meet in a part; the last level is one part.
        left = -(-left // FAN_IN)
        last = left == 1
        lists = (
            lists.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(left)))
            .groupBy(*query, "part")
            .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        )
    return lists.select(F.col("query_id"), F.posexplode("best").alias("place", "entry")).select(
        "query_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("entry.id").alias(id_column),
        F.bitwise_not("entry.worse").alias("score"),
    )
