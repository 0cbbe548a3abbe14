"""SHA-256 over a group's values in order, for groups of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values joined into one row before they meet the others of their group.
PIECE_VALUES = 2_000
#: Rows handed back at once.
OUT_ROWS = 200


def ordered_digest(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, separator: str, name: str = "digest"
) -> DataFrame:
    """(keys, ``name``): hex SHA-256 of each group's values, ascending by ``order``, joined by ``separator``.

    Values are strings without null. Groups are cut by range of (keys, order),
    joined piece by piece, and the pieces of a group are hashed one after the
    other as they are read: no group is held as a whole. A hash of a sequence
    needs its bytes in turn, so the pieces of one group go through one task.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    rows = df.select(*keys, F.col(order).cast("long").alias("_order"), value.alias("_value"))

    def batches_of(found, names, kinds):
        """Rows as batches; ``found`` yields tuples."""
        held = []
        for row in found:
            held.append(dict(zip(names, row, strict=True)))
            if len(held) >= OUT_ROWS:
                yield pa.RecordBatch.from_pylist(held, kinds())
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds())

    def rows_of(batches, seen):
        for batch in batches:
            seen[:] = [batch.schema.field(i) for i in range(batch.num_columns)]
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def join_pieces(batches):
        seen: list[pa.Field] = []

        def pieces():
            key, first, held = None, None, []
            for *k, at, v in rows_of(batches, seen):
                if held and (k != key or len(held) >= PIECE_VALUES):
                    yield *key, first, separator.join(held)
                    held = []
                if not held:
                    key, first = k, at
                held.append(v)
            if held:
                yield *key, first, separator.join(held)

        yield from batches_of(pieces(), [*keys, "_order", "_value"], lambda: pa.schema(seen))

    def hash_pieces(batches):
        seen: list[pa.Field] = []

        def digests():
            key, state = None, None
            for *k, _, v in rows_of(batches, seen):
                if state is not None and k == key:
                    state.update((separator + v).encode())
                    continue
                if state is not None:
                    yield *key, state.hexdigest()
                key, state = k, hashlib.sha256(v.encode())
            if state is not None:
                yield *key, state.hexdigest()

        kinds = [*keys, name]
        yield from batches_of(digests(), kinds, lambda: pa.schema([*seen[:-2], pa.field(name, pa.string())]))

    pieces = (
        rows.repartitionByRange(*keys, "_order")
        .sortWithinPartitions(*keys, "_order")
        .mapInArrow(join_pieces, f"{fields}, _order long, _value string")
    )
    return (
        pieces.repartition(*keys)
        .sortWithinPartitions(*keys, "_order")
        .mapInArrow(hash_pieces, f"{fields}, {name} string")
    )
