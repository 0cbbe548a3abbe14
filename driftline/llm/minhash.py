"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is the set of its distinct five-word shingles (lower-cased A-Z, words
``[^\\x20\\x09-\\x0D]+``; with fewer words its whole sequence is one shingle;
without words the set is empty and the document is linked with nothing).

1. *Classes.* Documents with equal sets form a class, found by a 128-bit digest
   of the set. Only the member with the smallest id goes on.
2. *Sketch* (Dahlgaard, Knudsen, Thorup 2017). In round ``i`` every shingle is
   thrown with a random value into a random one of ``t`` bins, from round ``t``
   on into bin ``i - t``; a bin keeps the smallest (round, value). Every bin is
   filled after at most ``2 t`` rounds, mostly after one or two, and agreement
   per coordinate is concentrated around the Jaccard similarity.
3. *Bands.* ``bands`` keys of ``rows`` coordinates each. A pair at similarity s
   shares no bucket with probability ``(1 - s**rows)**bands``: at the default
   25 bands of 5 rows 4e-7 at 0.85 and 2e-9 at 0.9.
4. *Stars.* In each bucket every member is paired with one centre, another one
   in every band, and confirmed on the full sets. Linked members become one
   component at once, so that thousands of near copies need some pairs per
   member, not all pairs.
5. *The rest.* Members of buckets that still hold two components are compared
   across components, first with other centres, then by rare shingles: a similar
   pair shares one of the shingles with which both begin, rarest first, so that
   what all near copies have in common makes no pairs. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.tables import components, write
from driftline.llm.words import NONE, find_words, long_column, mix, text_slices

WIDTH = 5
BANDS = 25
ROWS = 5
#: Ids of at most this many rows (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def shingle_set(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, width)
    total = np.full(n - size + 1, np.uint64(size))
    for j in range(size):
        total += mix(hashes[j : n - size + 1 + j] + np.uint64(j)) * np.uint64(2 * j + 3)
    return np.unique(mix(total))


def sketches(items: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` coordinates per set ``items[bounds[i]:bounds[i+1]]``; empty sets stay unfilled."""
    sizes = np.diff(bounds)
    out = np.full(len(sizes) * t, NONE)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * t):
        if not len(items):
            break
        x = mix(items ^ mix(np.array([i + 1], np.uint64)))
        if i < t:
            place = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)
        else:
            place = np.uint64(i - t)
        value = (np.uint64(i) << np.uint64(32)) | (x >> np.uint64(32))
        np.minimum.at(out, owner * t + place.astype(np.int64), value)
        open_rows = (out.reshape(-1, t) == NONE).any(axis=1)
        keep = open_rows[owner]
        items, owner = items[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One key per band, the band's number mixed in."""
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for j in range(parts.shape[2]):
        key = mix(key + parts[:, :, j])
    return key


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), long_column(values)).cast(
        pa.list_(pa.int64())
    )


def _slices(batches, id_column, text_column, width):
    """(ids, sets, bounds of the sets) of every slice of documents."""
    for batch in batches:
        for rows, buffer, offsets in text_slices(batch, text_column):
            words = find_words(buffer, offsets, lower=True)
            sets = [shingle_set(words.of(i), width) for i in range(rows.num_rows)]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield rows.column(id_column), items, bounds


def sketch_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, digest_a, digest_b, bands) per document; ``bands`` is empty for empty sets."""

    def work(batches):
        for ids, items, bounds in _slices(batches, "id", "text", width):
            sizes = np.diff(bounds)
            keys = band_keys(sketches(items, bounds, bands * rows), bands)
            full = sizes > 0
            running = [
                np.concatenate([[np.uint64(0)], np.cumsum(mix(items + np.uint64(s)), dtype=np.uint64)])
                for s in (11, 12)
            ]
            digests = [r[bounds[1:]] - r[bounds[:-1]] for r in running]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(sizes, pa.int64()),
                    *[long_column(d) for d in digests],
                    _lists(keys[full].ravel(), np.concatenate([[0], np.cumsum(full * bands)])),
                ],
                ["id", "n_shingles", "digest_a", "digest_b", "bands"],
            )

    rows_in = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, n_shingles long, digest_a long, digest_b long, bands array<long>"
    return rows_in.mapInArrow(work, schema)


def shingles_of(
    docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, width: int
) -> DataFrame:
    """(id, items) of the documents whose id is in ``wanted``."""

    def work(batches):
        for ids, items, bounds in _slices(batches, "id", "text", width):
            yield pa.RecordBatch.from_arrays([ids, _lists(items, bounds)], ["id", "items"])

    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows_in = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows_in.join(wanted, "id", "left_semi").mapInArrow(work, "id long, items array<long>")


def _linked(threshold: int) -> Column:
    shared = F.size(F.array_intersect("items", "other_items"))
    return 100 * shared >= threshold * (F.size("items") + F.size("other_items") - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("other_items"))
    left = sets.select(F.col("id").alias("a"), "items")
    return pairs.join(right, "b").join(left, "a").filter(_linked(threshold)).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: int = 85,
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document.

    Linked are documents with ``100 * intersection >= threshold * union``;
    ``component_id`` is the smallest id reachable. Rows with a null id take part
    in nothing and come back as kept without component; rows that repeat an id
    with the same text come back as often as they came. An empty table gives an
    empty one; other columns of ``docs`` are not looked at.
    """
    sketched = write(sketch_documents(docs, id_column, text_column, width, bands, rows), "sketches")
    digest = ["n_shingles", "digest_a", "digest_b"]
    classes = write(
        sketched.filter("n_shingles > 0 and id is not null")
        .groupBy(*digest)
        .agg(F.min(F.struct("id", "bands")).alias("first"))
        .select(*digest, "first.*"),
        "classes",
    )
    members = classes.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    # The centre differs from band to band, so that a member is compared with many others.
    order = F.xxhash64("id", "bucket")
    buckets = members.groupBy("bucket").agg(
        F.min(F.struct(order.alias("rank"), F.col("id"), F.col("n_shingles"))).alias("centre"),
        F.count(F.lit(1)).alias("n"),
    )
    shared = write(
        members.join(
            buckets.filter("n > 1").select(
                "bucket",
                F.col("centre.id").alias("centre"),
                F.col("centre.n_shingles").alias("centre_n"),
            ),
            "bucket",
        ),
        "buckets",
    )
    # A similar pair differs by at most this share in size.
    fits = (100 * F.least("n_shingles", "centre_n") >= threshold * F.greatest("n_shingles", "centre_n"))
    stars = write(
        shared.filter((F.col("id") != F.col("centre")) & fits)
        .select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
        .distinct(),
        "pairs",
    )
    wanted = write(shared.select("id").distinct(), "wanted")
    sets = write(shingles_of(docs, wanted, id_column, text_column, width), "sets")
    links = write(_confirmed(stars, sets, threshold), "links")
    group = _labels(links)
    mixed = _mixed(shared, group)
    if not mixed.isEmpty():
        mixed = write(_with_common(mixed, sets), "mixed")
        rest = write(_centre_pairs(mixed, threshold).join(stars, ["a", "b"], "left_anti"), "pairs")
        links = write(links.union(_confirmed(rest, sets, threshold)), "links")
        mixed = _mixed(mixed.drop("component", "common"), _labels(links))
        mixed = write(_with_common(mixed, sets), "mixed")
        last = _pairs_by_rare(mixed, sets, threshold).join(stars.union(rest), ["a", "b"], "left_anti")
        links = write(links.union(_confirmed(write(last, "pairs"), sets, threshold)), "links")
    group = _labels(links)
    found = classes.join(group, classes["id"] == group["node"], "left").select(
        *digest, F.coalesce("component", "id").alias("component")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (
        sketched.select("id", *digest)
        .join(found, digest, "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
    )


def _labels(links: DataFrame) -> DataFrame:
    return components(links) if not links.isEmpty() else links.toDF("node", "component")


def _mixed(shared: DataFrame, group: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with their component."""
    members = shared.join(
        group.select(F.col("node").alias("id"), "component"), "id", "left"
    ).withColumn("component", F.coalesce("component", "id"))
    mixed = (
        members.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("bucket")
    )
    return members.join(mixed, "bucket", "left_semi")


def _with_common(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``common``: how many of a member's shingles another component of ``mixed`` has.

    Members of two components cannot share more than the smaller ``common`` of the two.
    """
    ids = mixed.select("id", "component").distinct()
    items = sets.join(ids, "id").select("id", "component", F.explode("items").alias("item"))
    spread = (
        items.groupBy("item")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
    )
    common = items.join(spread, "item", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("common"))
    return mixed.join(common, "id", "left").select(
        "id", "n_shingles", "bucket", "component", F.coalesce("common", F.lit(0)).alias("common")
    )


def _able(mixed: DataFrame, threshold: int) -> DataFrame:
    """Without the members that have too much of their own for any link."""
    return mixed.filter(100 * F.col("common") >= threshold * F.col("n_shingles"))


def _centre_pairs(mixed: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of a bucket's members and its centre in another component that can be similar enough.

    The centre is the member with the fewest shingles of its own (the one the others were made from).
    """
    able = _able(mixed, threshold)
    least_own = F.struct(
        (F.col("n_shingles") - F.col("common")).alias("own"), F.col("id").alias("other"),
        F.col("n_shingles").alias("other_n"), F.col("common").alias("other_common"),
        F.col("component").alias("other_component"),
    )
    centres = able.groupBy("bucket").agg(F.min(least_own).alias("c")).select("bucket", "c.*").drop("own")
    most = F.least("common", "other_common")
    fits = 100 * most >= threshold * (F.col("n_shingles") + F.col("other_n") - most)
    pairs = able.join(centres, "bucket").filter((F.col("component") != F.col("other_component")) & fits)
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _pairs_by_rare(mixed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) in different components that can be similar enough, every such pair of ``mixed``.

    Each member's shingles that another component has are put in one order, rarest
    first. A pair that has to share ``need`` of them shares one that has ``need - 1``
    or more behind it on both sides, so members meet by these only, not by what
    nearly all of them have.
    """
    able = _able(mixed, threshold).select("id", "n_shingles", "component").distinct()
    items = sets.join(able, "id").select("id", "n_shingles", "component", F.explode("items").alias("item"))
    spread = (
        items.groupBy("item")
        .agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("item", "members")
    )
    ordered = (
        items.join(spread, "item")
        .groupBy("id", "n_shingles", "component")
        .agg(F.sort_array(F.collect_list(F.struct("members", "item"))).alias("items"))
    )
    # The smallest set that fits needs threshold per cent of this one.
    first = F.size("items") - F.ceil(threshold * F.col("n_shingles") / 100).cast("int") + 1
    placed = (
        ordered.withColumn("common", F.size("items"))
        .filter(first > 0)
        .select("id", "n_shingles", "component", "common", F.posexplode(F.slice("items", 1, first)))
        .select("id", "n_shingles", "component", F.col("col.item").alias("item"), (F.col("common") - F.col("pos")).alias("left"))
    )
    placed = write(placed, "placed")
    # Members of an item's largest component need no comparison with each other.
    sizes = placed.groupBy("item", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("item").agg(F.max(F.struct("n", "component")).alias("m"))
    largest = largest.select("item", F.col("m.component").alias("largest"))
    one = placed.join(largest, "item").filter("component <> largest").select(
        "item", F.col("id").alias("other"), F.col("n_shingles").alias("other_n"), F.col("left").alias("other_left"),
        F.col("component").alias("other_component"), "largest",
    )
    need = threshold * (F.col("n_shingles") + F.col("other_n"))
    pairs = placed.join(
        one,
        (placed["item"] == one["item"])
        & (F.col("component") != F.col("other_component"))
        & ((F.col("component") == F.col("largest")) | (F.col("id") < F.col("other")))
        & ((100 + threshold) * F.least("left", "other_left") >= need),
    )
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
