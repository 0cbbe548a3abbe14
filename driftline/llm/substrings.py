"""Passages that repeat: windows of documents joined to an index of all reference blocks.

A window is ``width`` consecutive words of a document. A word is removed if a
window that covers it also starts earlier (in a document with a smaller id, or
earlier in the same one); windows are judged on the input as it came.

1. *Copies.* Documents with equal word sequences form a class by a 128-bit
   digest. All but the first one start earlier elsewhere with every window.
2. *Index.* From every window the smallest hash of its ``gram``-word runs is
   kept: equal windows keep equal ones, so that about one word in seven stands
   for its block. Blocks whose hash occurs once in the corpus match nothing.
3. *References.* The windows of the other blocks are indexed by their hash; the
   first occurrence of each is its reference.
4. *Factors.* A hash join with the references finds every repeated window; runs
   of windows that go on word by word in one reference are then put together.
   These factors are the duplicate spans. Nothing is extended against a
   reference, so this is not a relative Lempel-Ziv parse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import write
from driftline.llm.words import NONE, Words, find_words, long_column, mix, sequence_hashes, sliding, text_slices

WIDTH = 20
GRAM = 8


def _kept_hashes(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(each window's kept hash, places of the kept runs); windows start at valid places only."""
    n = len(words.hashes)
    if n < width:
        return np.full(n, NONE), np.empty(0, np.int64)
    ends = np.repeat(words.bounds[1:], np.diff(words.bounds))
    runs = np.full(n, NONE)
    runs[: n - gram + 1] = sequence_hashes(words.hashes, gram) >> np.uint64(1)
    windows = np.full(n, NONE)
    span = width - gram + 1
    windows[: n - width + 1] = sliding(runs[: n - gram + 1], span)
    windows[np.arange(n) + width > ends] = NONE
    lowest = np.where(windows == NONE, np.uint64(0), windows)
    reached = sliding(np.concatenate([np.zeros(span - 1, np.uint64), lowest]), span, np.maximum)
    return windows, np.flatnonzero((reached == runs) & (runs != NONE))


def _blocks(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(id, n_words, digest_a, digest_b, blocks): a hash that a document has twice is listed twice."""

    def work(batches):
        for batch in batches:
            for rows, buffer, offsets in text_slices(batch):
                words = find_words(buffer, offsets, lower=False)
                _, places = _kept_hashes(words, width, gram)
                kept = (sequence_hashes(words.hashes, gram) >> np.uint64(1))[places]
                edges = np.searchsorted(places, words.bounds)
                lists = []
                for i in range(rows.num_rows):
                    keys, counts = np.unique(kept[edges[i] : edges[i + 1]], return_counts=True)
                    lists.append(np.repeat(keys, np.minimum(counts, 2)))
                place = np.arange(len(words.hashes)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
                digests = []
                for seed in (21, 22):
                    x = mix(words.hashes + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(seed)))
                    running = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
                    digests.append(running[words.bounds[1:]] - running[words.bounds[:-1]])
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                values = np.concatenate(lists) if lists else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        *[long_column(d) for d in digests],
                        pa.ListArray.from_arrays(pa.array(bounds), long_column(values)),
                    ],
                    ["id", "n_words", "digest_a", "digest_b", "blocks"],
                )

    return docs.mapInArrow(
        work, "id long, n_words long, digest_a long, digest_b long, blocks array<long>"
    )


def _windows(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """(window, id, start) of the windows whose kept hash is among the document's ``blocks``."""

    def work(batches):
        for batch in batches:
            for rows, buffer, offsets in text_slices(batch):
                words = find_words(buffer, offsets, lower=False)
                kept, _ = _kept_hashes(words, width, gram)
                hashes = sequence_hashes(words.hashes, width)
                lists = rows.column("blocks")
                edges = lists.offsets.to_numpy()
                known = lists.values.to_numpy().view(np.uint64)
                ids = rows.column("id").to_numpy()
                for i in range(rows.num_rows):
                    a, b = words.bounds[i], words.bounds[i + 1] - width + 1
                    if b <= a:
                        continue
                    found = np.flatnonzero(np.isin(kept[a:b], known[edges[i] : edges[i + 1]]))
                    if len(found):
                        yield pa.RecordBatch.from_arrays(
                            [
                                long_column(hashes[a + found]),
                                pa.array(np.full(len(found), ids[i]), pa.int64()),
                                pa.array(found, pa.int64()),
                            ],
                            ["window", "id", "start"],
                        )

    return texts.mapInArrow(work, "window long, id long, start long")


def _slim(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))


def duplicate_windows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    width: int = WIDTH, gram: int = GRAM,
) -> tuple[DataFrame, DataFrame]:
    """(copies, windows): (id, source_id) of documents that are copies of an earlier one, and
    (id, start, source_id, source_start) of the other documents' windows that start earlier elsewhere.
    """
    rows = _slim(docs, id_column, text_column).filter("id is not null")
    blocks = write(_blocks(rows, width, gram).filter(F.col("n_words") >= width), "blocks")
    digest = ["n_words", "digest_a", "digest_b"]
    firsts = blocks.groupBy(*digest).agg(F.min("id").alias("source_id"))
    classed = write(blocks.join(firsts, digest), "classes")
    copies = classed.filter("id <> source_id").select("id", "source_id").distinct()
    originals = classed.filter("id = source_id")
    listed = originals.select("id", F.explode("blocks").alias("block"))
    # Written, so that a very common block's rows can be split among tasks by the join.
    repeated = listed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = write(repeated.select("block"), "repeated")
    matched = write(
        listed.distinct().join(repeated, "block").groupBy("id").agg(F.collect_list("block").alias("blocks")),
        "matched",
    )
    windows = write(_windows(rows.join(matched, "id"), width, gram), "windows")
    references = (
        windows.groupBy("window")
        .agg(F.min(F.struct("id", "start")).alias("source"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("window", F.col("source.id").alias("source_id"), F.col("source.start").alias("source_start"))
    )
    later = windows.join(write(references, "references"), "window").filter(
        (F.col("id") != F.col("source_id")) | (F.col("start") != F.col("source_start"))
    )
    return copies, later.select("id", "start", "source_id", "source_start")


def parse_factors(starts, source_ids, source_starts, width: int = WIDTH):
    """(start, length, source id, source start) of the runs that go on in one reference."""
    order = np.argsort(starts, kind="stable")
    starts, source_ids, source_starts = starts[order], source_ids[order], source_starts[order]
    breaks = np.flatnonzero(
        (np.diff(starts) != 1) | (np.diff(source_ids) != 0) | (np.diff(source_starts) != 1)
    ) + 1
    opens, closes = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(starts)]])
    return starts[opens], closes - opens + width - 1, source_ids[opens], source_starts[opens]


FACTORS = "array<struct<start:long,length:long,source_id:long,source_start:long>>"


def duplicate_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    width: int = WIDTH, gram: int = GRAM,
) -> DataFrame:
    """(id, copy_of, factors): one row per document with repeated words.

    ``copy_of`` is the first document with the same words (then all words are
    one factor and ``factors`` is null), else null. Start and length count words.
    """
    copies, windows = duplicate_windows(docs, id_column, text_column, width, gram)

    def parse(starts: pa.Array, ids: pa.Array, source_starts: pa.Array) -> pa.Array:
        edges, lists = [0], []
        values = [a.values.to_numpy() for a in (starts, ids, source_starts)]
        at = starts.offsets.to_numpy()
        for i in range(len(starts)):
            lists.append(parse_factors(*[v[at[i] : at[i + 1]] for v in values], width))
            edges.append(edges[-1] + len(lists[-1][0]))
        columns = [np.concatenate(c) for c in zip(*lists, strict=True)] or [np.empty(0, np.int64)] * 4
        names = ["start", "length", "source_id", "source_start"]
        items = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items)

    # The windows of one document: no more than its words.
    row = F.struct("start", "source_id", "source_start")
    each = windows.groupBy("id").agg(F.collect_set(row).alias("w"))
    factors = each.select(
        "id",
        F.lit(None).cast("long").alias("copy_of"),
        F.arrow_udf(parse, FACTORS)("w.start", "w.source_id", "w.source_start").alias("factors"),
    )
    return factors.union(
        copies.select("id", F.col("source_id").alias("copy_of"), F.lit(None).cast(FACTORS))
    )


def remove_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    width: int = WIDTH, gram: int = GRAM,
) -> DataFrame:
    """(id, n_words, n_removed, kept) per row; ``kept`` are the kept words joined by blanks.

    Null texts and texts without words have no words and the empty string. Rows
    without id neither lose words nor make others lose any; rows that repeat an
    id count as one document. An empty table gives an empty one; further columns
    are not looked at.
    """
    spans = write(duplicate_spans(docs, id_column, text_column, width, gram), "spans")
    rows = _slim(docs, id_column, text_column).join(spans, "id", "left")

    def work(batches):
        for batch in batches:
            for part, buffer, offsets in text_slices(batch):
                words = find_words(buffer, offsets, lower=False)
                sizes = np.diff(words.bounds)
                gone = np.zeros(len(words.hashes) + 1, np.int64)
                copied = part.column("copy_of").is_valid().to_numpy(zero_copy_only=False)
                for i, factors in enumerate(part.column("factors").to_pylist()):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    if copied[i]:
                        gone[a] += 1
                        gone[b] -= 1
                    for f in factors or ():
                        gone[a + f["start"]] += 1
                        gone[a + f["start"] + f["length"]] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                data = buffer.tobytes()
                texts = []
                for i in range(part.num_rows):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    keep = np.flatnonzero(stays[a:b]) + a
                    pairs = zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)
                    texts.append(b" ".join([data[s:e] for s, e in pairs]))
                removed = sizes - np.add.reduceat(np.append(stays, False), words.bounds[:-1]) * (sizes > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_words", "n_removed", "kept"],
                )

    schema = "id long, n_words long, n_removed long, kept string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_column)
