"""Hard negatives against brute force on unbounded integers, and exact products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from driftline.llm import negatives as hn
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, id long, tile string, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash", 1) for r in rows], SCHEMA)


def brute(rows, k=5, low=80, high=100, every=10):
    usable = [
        (i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    limit = 2**63
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        scored = [
            (-min(max(sum(x * y for x, y in zip(v, w, strict=True)), -limit), limit - 1), i, same == label)
            for i, same, w in usable if i != a and len(w) == len(v)
        ]
        near = sorted((s, i) for s, i, same in scored if same)[:k]
        for s, p in near:
            inside = sorted((t, i) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s)
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(inside[:k])]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 47), (64, 64, 64), (130, 70, 201), (7, 300, 40)])
def test_strassen(shape):
    m, k, n = shape
    rng = np.random.default_rng(1)
    for top in (3, 2**20, 2**62):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (hn.strassen(a, b, 8) == a @ b).all() and (hn.strassen(a, b) == a @ b).all()
    a, b = a.astype(object) * 2**80, b.astype(object)
    assert (hn.strassen(a, b, 16) == a @ b).all()


def test_scores_beyond_doubles_and_longs():
    a = np.array([[2**40 + 1, 1], [2**60, 2**60], [-(2**61), 3]])
    b = np.array([[2**20 + 1, 7], [2**61, 2**61]])
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    got = hn.scores(a, b)
    assert got.tolist() == [[min(max(x, -(2**63)), 2**63 - 1) for x in row] for row in want]
    assert hn.whole_components(np.array([[1e300, -0.001]]), 256).tolist() == [[int(256e300), -1]]


def some_rows(seed, n=400, width=12):
    rng = random.Random(seed)
    rows = [
        (i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(width)], rng.choice([0, 0, 0, 1, 2, 3]))
        for i in rng.sample(range(-50, 1000), n)
    ]
    same = [0.25] * width
    # Ties by the hundred, repeated rows, an anchor that comes twice, and rows that take no part.
    rows += [(2000 + i, same, i % 3) for i in range(120)] + [(2121, same, 1)] * 3 + [(3000, same, 0)] * 2
    rows += [(5000, None, 0), (5010, [], 0), (5020, [1.0, None], 0), (5030, [math.inf] * width, 0), (5040, [math.nan] * width, 1)]
    rows += [(5050, same, None), (None, same, 0), (5060, [1.0, 2.0], 0), (5061, [1.0, 2.5], 0), (5062, [1.0, 1.5], 1)]
    rows += [(5100, [0.0] * width, 3), (5110, [-1.0] * width, 7), (5111, [-1.0] * width, 8)]
    return rows


@pytest.mark.parametrize("sizes", [(4096, 512, 32), (16, 4, 2), (7, 3, 1)])
def test_hard_negatives(spark, sizes):
    rows = some_rows(sizes[0])
    df = frame(spark, rows).repartition(4)
    shard, anchor, group = sizes
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, shard_rows=shard, anchor_rows=anchor, group_tiles=group)
    assert found(got) == brute(rows)


def test_other_windows_and_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 6, 12, 16]) for _ in range(3)], i % 4) for i in range(150)]
    rows += [(200 + i, [1e300 * rng.choice([1, -1]), 1.0, 2.0], i % 2) for i in range(20)]
    got = hn.hard_negatives(
        frame(spark, rows), F.col("vec_id") % 10 == 0, positives=3, negatives=4, low=50, high=130, shard_rows=32
    )
    want = []
    for row in brute(rows, 5, 50, 130):
        want.append(row)
    kept = {(a, p) for a, p, *_ in brute_pairs(rows, 3)}
    assert found(got) == [r for r in want if (r[0], r[1]) in kept and r[2] <= 4]


def brute_pairs(rows, k):
    """(anchor, positive) of the first ``k`` positives."""
    limit = 2**63
    usable = [(i, label, [math.floor(256 * x) if abs(x) < 1e305 else int(x) * 256 for x in v]) for i, v, label in rows]
    for a, label, v in usable:
        if a % 10 == 0:
            scored = [
                (-min(max(sum(x * y for x, y in zip(v, w, strict=True)), -limit), limit - 1), i)
                for i, same, w in usable if i != a and same == label
            ]
            yield from ((a, i) for _, i in sorted(scored)[:k])


def test_nothing(spark):
    for rows in ([], [(10, [1.0], 0)], [(10, [1.0], 0), (11, [1.0], 0)], [(10, [1.0], 0), (11, [1.0], 1)]):
        assert found(hn.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute(rows) == []
