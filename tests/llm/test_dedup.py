"""Near copies, repeated passages and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from driftline.llm import fingerprints, minhash, queries, substrings
from driftline.llm.tables import components, recorded
from driftline.llm.words import find_words
from tests.llm.conftest import frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])


def brute_components(rows, threshold=85):
    rows = [r for r in rows if r[0] is not None]
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


def got(df):
    return sorted(tuple(r)[:4] for r in df.collect() if r[0] is not None)


def test_near_copies_of_odd_rows(odd, odd_rows):
    found = minhash.near_duplicates(odd)
    assert got(found) == brute_components(odd_rows)
    lost = [r for r in found.collect() if r[0] is None]
    assert [(r["component_id"], r["kept"]) for r in lost] == [(None, True)] * 2


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
    return " ".join(w)


def test_near_copies_around_the_threshold(spark):
    """A large group of near copies, many of them just below the threshold, chains, other texts."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(9999)}" for _ in range(150))
    rows = [(i, edited(rng, base, rng.randrange(6)), "en", "a") for i in range(120)]
    chain = base
    for i in range(200, 220):
        chain = edited(rng, chain, 1)
        rows.append((i, chain, "en", "b"))
    rows += [(300 + i, words(rng, 5), "en", "c") for i in range(30)]
    rng.shuffle(rows)
    assert got(minhash.near_duplicates(frame(spark, rows))) == brute_components(rows)


def test_copies_just_below_the_threshold_make_few_pairs(spark):
    """120 copies that are like each other, but of which half is linked with nothing: some pairs a member."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        copy = base.copy()
        if i % 2:
            copy[20] = "shared"
        for place in rng.sample(range(30, 145), 2 if i % 2 else 1):
            copy[place] = f"e{i}x{place}"
        rows.append((i, " ".join(copy), "en", "a"))
    want = brute_components(rows)
    assert len({c for _, _, c, _ in want}) > 50
    with recorded() as made:
        assert got(minhash.near_duplicates(frame(spark, rows))) == want
    pairs = [t.count() for t in made if "/pairs-" in (t.inputFiles() or [""])[0]]
    assert len(pairs) == 3 and pairs[-1] < 15 * len(rows)


def test_no_documents(nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    assert substrings.remove_duplicates(nothing).count() == 0
    assert fingerprints.with_next(nothing).count() == 0


def test_sketches_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    agreed = []
    for _ in range(200):
        items = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = items[:260], items[40:]  # 220 of 300 shared
        both = np.concatenate([a, b])
        s = minhash.sketches(both, np.array([0, 260, 520]), 125)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        agreed.append((s[0] == s[1]).mean())
    assert abs(np.mean(agreed) - 220 / 300) < 0.01


def test_short_sets_fill_every_bin():
    s = minhash.sketches(np.array([7], np.uint64), np.array([0, 1, 1]), 50)
    assert (s[0] != s[1]).all() and len(set(s[0].tolist())) > 1


def brute_repeats(rows, width=20):
    """Earlier windows by document id; rows that repeat an id are one document."""
    seen, out = {}, {}
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[s : s + width]), (i, s)) != (i, s):
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_passages_of_odd_rows(odd, odd_rows):
    want = brute_repeats(odd_rows)
    for row in substrings.remove_duplicates(odd).collect():
        have = (row["n_words"], row["n_removed"], hashlib.sha256(row["kept"].encode()).hexdigest())
        if row["doc_id"] is not None:
            assert have == want[row["doc_id"]], row["doc_id"]
        else:
            assert row["n_removed"] == 0


def test_repeated_passages_on_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_repeats(rows)
    found = {r[0]: tuple(r)[1:] for r in queries.op5_substring_dedup(spark, folder).collect()}
    assert found == want


def test_factors_name_their_source(spark):
    rng = random.Random(2)
    a, b = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(60)) for p in "ab")
    mixed = " ".join(a.split()[10:40] + b.split()[5:45])
    rows = [(1, a, "en", "x"), (2, b, "en", "x"), (3, mixed, "en", "x"), (4, a, "en", "x")]
    spans = {r["id"]: r for r in substrings.duplicate_spans(frame(spark, rows)).collect()}
    assert [tuple(f) for f in spans[3]["factors"]] == [(0, 30, 1, 10), (30, 40, 2, 5)]
    assert spans[4]["copy_of"] == 1 and spans[4]["factors"] is None and set(spans) == {3, 4}


@pytest.mark.parametrize("lower", [True, False])
def test_words_as_bytes(lower):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aBé \t\n\x0b\x85　z") for _ in range(rng.randrange(20))) for _ in range(500)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    found = find_words(np.frombuffer(b"".join(data), np.uint8), offsets, lower)
    table = {}
    for i, t in enumerate(texts):
        want = WORD.findall(t.translate(LOWER) if lower else t)
        assert len(found.of(i)) == len(want)
        for h, w in zip(found.of(i).tolist(), want, strict=True):
            assert table.setdefault(w, h) == h
    assert len(set(table.values())) == len(table)


def test_fingerprints_of_odd_rows(spark, odd, odd_rows):
    chained = fingerprints.with_next(odd, bucket_rows=3)
    order = sorted({r[0] for r in odd_rows if r[0] is not None})
    texts = {r[0]: r[1] or "" for r in odd_rows}
    for row in chained.collect():
        if row["id"] is None:
            assert row["next_text"] is None
        elif row["id"] != 3:  # repeated: followed by itself once
            following = order[(order.index(row["id"]) + 1) % len(order)]
            assert row["next_text"] == texts[following]
    assert chained.count() == len(odd_rows)


def test_trees_lose_nothing_and_locate_edits(spark):
    from pyspark.sql import functions as F

    text = "First section. It has!\nTwo paragraphs...\n\nSecond?\nand " + "long " * 40 + "\n\n...\n"
    df = spark.createDataFrame([(text, text.replace("Second", "Other")), ("", "a"), (None, None)], "a string, b string")
    df = df.select("a", "b", fingerprints.tree(F.col("a")).alias("x"), fingerprints.tree(F.col("b")).alias("y"))
    df = df.select(
        fingerprints.edited_paragraphs(F.col("x"), F.col("y")).alias("edits"),
        fingerprints.likeness(
            fingerprints.root(F.col("x")), fingerprints.pieces(F.col("x")),
            fingerprints.root(F.col("y")), fingerprints.pieces(F.col("y")),
        ).alias("near"),
        F.concat_ws("", F.flatten(F.transform(
            F.regexp_extract_all("a", F.lit(fingerprints.SECTION), F.lit(0)),
            lambda s: F.flatten(F.transform(
                F.regexp_extract_all(s, F.lit(fingerprints.PARAGRAPH), F.lit(0)),
                lambda p: F.regexp_extract_all(p, F.lit(fingerprints.PIECE), F.lit(0)),
            )),
        ))).alias("again"),
    )
    first, second, third = df.collect()
    assert first["again"] == text and [tuple(e) for e in first["edits"]] == [(1, 0)]
    assert 0.5 < first["near"] < 1 and second["near"] == 0 and third["near"] == 1


def test_components_of_chains_stars_and_odd_edges(spark):
    """Long chains against their order, hubs with a large number, repeated and looped edges, no edge."""
    rng = random.Random(11)
    chain = rng.sample(range(1000, 1200), 150)
    pairs = list(zip(chain, chain[1:], strict=False)) + [(5000, i) for i in range(300, 360)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    pairs += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    root = {i: i for p in pairs for i in p if p[0] != p[1]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in pairs:
        if x != y:
            x, y = sorted((find(x), find(y)))
            root[y] = x
    df = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    assert sorted(map(tuple, components(df).collect())) == sorted((i, find(i)) for i in root)
    assert components(df.limit(0)).collect() == []
