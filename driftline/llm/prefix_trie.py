"""The trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that start with it. Turns become 128-bit digests where they are
read; texts go no further.

1. *Prefix digests.* A prefix is the running exclusive-or of its turns' digests,
   each mixed with its position.
2. *Count-min screening.* All prefixes are counted in a sketch of two rows of
   counters that stop at 3. A sketch never counts too little, so an estimate of
   one proves a prefix that no other conversation has. Every longer prefix of
   that conversation is then its own as well: this tail is emitted where it is
   read, without a shuffle.
3. *Exact grouping.* Only prefixes with a larger estimate are grouped by their
   digests, depth by depth.
4. *Owners.* A conversation owns the nodes whose smallest member it is. As it is
   one at every greater depth too, one number tells its nodes: the depth at
   which it leaves its smaller neighbours. Children, leaves and saved tokens of a
   node are then sums over its members, without a walk through the tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.segments import row_numbers, running_totals
from driftline.llm.digests import ordered_digest
from driftline.llm.tables import write

WORD = r"[^\x20\x09-\x0D]+"
#: Counters of a sketch row: about four for each prefix, at most 2**27 (two rows of 32 MB).
LEAST_BITS, MOST_BITS = 12, 27
#: Counters that are packed and merged together (four in a byte).
BLOCK = 1 << 16
#: Conversations of one group start alike: their ids share the quotient by 20.
FAMILY, HEADS = 20, 4


def turns(conversations: DataFrame, id_column: str = "conv_id", hot_rows: int | None = None) -> DataFrame:
    """(conv_id, pos, a, b, words): the turns in order from 1, as digests of (role, text).

    Null turns come first; turns of equal number stand by their digests. Rows
    without conversation take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("conv_id"),
        F.col("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(1), role).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    more = {} if hot_rows is None else {"hot_rows": hot_rows, "chunk_rows": hot_rows}
    return row_numbers(slim, ["conv_id"], "turn", ["a", "b"], "pos", **more).drop("turn")


def shared_heads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, rebuilt turns): each conversation c begins with the first h turns of c - c % 20.

    h is the CRC-32 of the decimal id, modulo 4; the conversation's own first h
    turns go. Conversations: (conv_id, length) of all, those without turns as well.
    """
    lengths = rows.groupBy("conv_id").agg(F.max("pos").alias("own"))
    asked = lengths.select(
        "conv_id", "own",
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
    )
    # At most three short rows a family.
    first = rows.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head")
    )
    none = F.array().cast(heads.schema["head"].dataType)
    known = asked.join(heads, "base", "left").withColumn(
        "head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), none)
    )
    known = write(
        known.select(
            "conv_id", "h", "head", F.size("head").alias("kept"),
            (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"),
        ),
        "rebuilt",
    )
    led = known.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    tail = rows.join(known.select("conv_id", "h", "kept"), "conv_id").filter(F.col("pos") > F.col("h"))
    tail = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "a", "b", "words")
    return known.select("conv_id", "length"), led.unionByName(tail)


def prefixes(conversations: DataFrame, rows: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(conv_id, depth, a, b, words, total, length): every prefix, the root (depth 0) included.

    ``a`` and ``b`` are its digest, ``words`` those of its last turn, ``total``
    those of all its turns.
    """
    placed = rows.select("conv_id", F.col("pos").alias("depth"), "a", "b", "words").unionByName(
        conversations.select(
            "conv_id", F.lit(0).cast("long").alias("depth"),
            *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "words")],
        )
    )
    mixed = {f"p{c}": F.when(F.col("depth") > 0, F.xxhash64(c, "depth", F.lit(seed)))
             for seed, c in enumerate("ab")}
    more = {} if hot_rows is None else {"hot_rows": hot_rows, "chunk_rows": hot_rows}
    run = running_totals(placed, ["conv_id"], ["depth"], {"total": "words"}, mixed, **more)
    run = run.drop("a", "b").withColumnsRenamed({"pa": "a", "pb": "b"})
    return run.join(conversations, "conv_id")


# --- the sketch ---------------------------------------------------------------


def _bins(batch: pa.RecordBatch, bits: int) -> list[np.ndarray]:
    """Each prefix's counter in the two rows of the sketch, the second row after the first."""
    mask = np.uint64((1 << bits) - 1)
    both = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in "ab")
    depth = batch.column(batch.schema.get_field_index("depth")).to_numpy().view(np.uint64)
    spread = depth * np.uint64(0x9E3779B97F4A7C15)
    return [((x + spread) & mask).astype(np.int64) + (row << bits) for row, x in enumerate(both)]


def _packed(counts: np.ndarray) -> bytes:
    quarter = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    return (quarter << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return ((np.frombuffer(data, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).ravel()


def count_min(rows: DataFrame, bits: int) -> list[bytes | None]:
    """The sketch of all prefixes in blocks of packed counters; a block of zeros is None.

    Every task counts its rows in one array (2**28 bytes at most), blocks with
    counts are summed by a shuffle, one after the other, and stop at 3 a counter.
    """
    block = min(BLOCK, 1 << bits)

    def count(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            found, times = np.unique(np.concatenate(_bins(batch, bits)), return_counts=True)
            owner = found // block
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(found)], strict=True):
                held = counts.setdefault(int(owner[a]), np.zeros(block, np.uint8))
                at = found[a:b] % block
                held[at] = np.minimum(held[at] + times[a:b], 3)
        for key, held in counts.items():
            yield pa.RecordBatch.from_pydict({"block": [key], "counts": [_packed(held)]})

    def merge(batches):
        key, held = None, None
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pydict({"block": [key], "counts": [_packed(held)]})
                    key, held = k, np.zeros(block, np.uint8)
                held = np.minimum(held + _unpacked(data), 3)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"block": [key], "counts": [_packed(held)]})

    schema = "block long, counts binary"
    local = rows.select("a", "b", "depth").mapInArrow(count, schema)
    merged = local.repartition("block").sortWithinPartitions("block").mapInArrow(merge, schema)
    sketch: list[bytes | None] = [None] * ((2 << bits) // block)
    # At most 64 MB, however many prefixes there are (MOST_BITS).
    for row in merged.toLocalIterator():
        sketch[row["block"]] = bytes(row["counts"])
    return sketch


def screened(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Adds ``shared``: false where the sketch proves that no other conversation has the prefix."""
    spark = rows.sparkSession
    if bits is None:
        bits = min(max(LEAST_BITS, int(4 * rows.count()).bit_length()), MOST_BITS)
    known = spark.sparkContext.broadcast(count_min(rows, bits))
    block = min(BLOCK, 1 << bits)
    schema = rows.withColumn("shared", F.lit(True)).schema

    def look_up(batches):
        sketch = known.value
        for batch in batches:
            least = np.full(batch.num_rows, 3, np.uint8)
            for at in _bins(batch, bits):
                owner = at // block
                order = np.argsort(owner, kind="stable")
                found = np.empty(batch.num_rows, np.uint8)
                edges = np.flatnonzero(np.diff(owner[order], prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                    rows_here = order[a:b]
                    inside = at[rows_here] % block
                    data = np.frombuffer(sketch[int(owner[rows_here[0]])], np.uint8)
                    found[rows_here] = (data[inside // 4] >> (2 * (inside % 4)).astype(np.uint8)) & 3
                least = np.minimum(least, found)
            # Below a prefix of its own a conversation shares nothing either.
            conv, depth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("conv_id", "depth"))
            order = np.lexsort((depth, conv))
            own = np.cumsum(least[order] == 1)
            starts = np.flatnonzero(np.diff(conv[order], prepend=conv[order][:1] - 1))
            before = np.concatenate([[0], own])[starts]
            shared = np.empty(batch.num_rows, bool)
            shared[order] = own - np.repeat(before, np.diff([*starts, len(order)])) == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared)], [*batch.schema.names, "shared"])

    return rows.mapInArrow(look_up, schema)


# --- nodes --------------------------------------------------------------------

NODE = ["depth", "a", "b"]


def trie(conversations: DataFrame, rows: DataFrame, bits: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """One row per node of the trie over ``conversations`` (conv_id, length) and their turns ``rows``.

    conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens (words of turns that members
    need not repeat, over the subtree) and ends_sha256 (of the members that end
    here). No conversation: no node. ``bits`` sets the sketch's width; any width
    gives the same rows.
    """
    seen = write(screened(write(prefixes(conversations, rows, hot_rows), "prefixes"), bits), "screened")
    possible = seen.filter("shared")
    own_end = F.when(F.col("depth") == F.col("length"), F.col("conv_id"))
    first = write(
        possible.groupBy(*NODE).agg(
            F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.count(own_end).alias("ends"),
        ),
        "nodes",
    )
    # Read from written tables, so that a very common node's rows can be split among tasks by the join.
    placed = write(possible.join(first, NODE), "placed")
    behind = F.col("first") < F.col("conv_id")
    at_end = F.col("depth") == F.col("length")
    facts = placed.groupBy("conv_id").agg(
        F.coalesce(F.max(F.when(behind, F.col("depth"))), F.lit(-1)).alias("left_at"),
        F.max_by(F.struct("first", "total"), F.when(behind, F.col("depth"))).alias("near"),
        # A conversation that ends among shared prefixes is a leaf where nothing goes on and it is the first.
        F.max(F.when(at_end, (F.col("n") == F.col("ends")) & ~behind)).alias("leaf"),
    )
    facts = write(
        facts.select(
            "conv_id", "left_at", F.col("near.first").alias("near"), F.col("near.total").alias("near_total"),
            F.coalesce("leaf", F.lit(True)).cast("long").alias("leaf"),
        ),
        "conversations",
    )
    member = placed.join(facts, "conv_id")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(
        F.col("depth") - 1 > F.col("left_at"), F.col("conv_id")
    ).otherwise(F.col("near"))
    goes_on = (F.col("length") > F.col("depth")) & (F.col("depth") >= F.col("left_at"))
    saved = F.when(
        F.col("depth") <= F.col("left_at"), F.col("near_total") - F.col("total") + F.col("words")
    ).otherwise(F.lit(0))
    grouped = member.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", parent.alias("parent"))).alias("top"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(goes_on.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
        F.min(own_end).alias("end"),
        F.count(own_end).alias("ends"),
    )
    grouped = write(grouped, "grouped")
    many = grouped.filter("ends > 1").select(*NODE)
    listed = possible.filter(at_end).join(many, NODE)
    digests = ordered_digest(listed, NODE, "conv_id", F.col("conv_id").cast("string"), ",")
    ends = F.coalesce("digest", F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256))
    shared = grouped.join(digests, NODE, "left").select(
        F.col("top.conv_id").alias("conv_id"), "depth", F.col("top.parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"),
    )
    # The tails that no other conversation has; only the first node of one may have another's parent.
    tails = seen.filter("not shared")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    borders = facts.filter("left_at >= 0").select("conv_id", (F.col("left_at") + 1).alias("depth"), "near")
    alone = tails.join(borders, ["conv_id", "depth"], "left").select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("near", "conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), (F.col("length") > F.col("depth")).cast("long").alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"),
        F.sha2(F.coalesce(own_end.cast("string"), F.lit("")), 256).alias("ends_sha256"),
    )
    return shared.unionByName(alone)


def conversation_trie(conversations: DataFrame, bits: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """:func:`trie` of the conversations as they come, without exchanged beginnings."""
    rows = write(turns(conversations, hot_rows=hot_rows), "turns")
    lengths = write(rows.groupBy("conv_id").agg(F.max("pos").alias("length")), "lengths")
    return trie(lengths, rows.select("conv_id", "pos", "a", "b", "words"), bits, hot_rows)


def rebuilt_trie(conversations: DataFrame, bits: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """:func:`trie` of conversations that take their beginnings from each twentieth one (:func:`shared_heads`).

    Null roles and texts are empty ones; null turns come first; turns of equal
    number stand by their digests; rows without conversation take no part; rows
    that repeat stay repeated turns; an empty table gives no node; further
    columns are not looked at.
    """
    lengths, rows = shared_heads(write(turns(conversations, hot_rows=hot_rows), "turns"))
    return trie(lengths, rows, bits, hot_rows)
