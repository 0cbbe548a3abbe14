import random
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from driftline.functions.segments import _chunked, hot_keys, latest_before, row_numbers, running_totals, with_previous

T0 = datetime(2024, 1, 1)


def sample(n, seed, keys="abc", hot="a"):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = hot if rng.random() < 0.6 else rng.choice([*keys, None])
        out.append((key, T0 + timedelta(seconds=rng.randrange(0, 40_000)), i, rng.randrange(5)))
    return out


SCHEMA = "k string, ts timestamp, id long, v long"


@pytest.mark.parametrize("chunk", [(20, 5), (100, 40), (10**6, 10**6)])
def test_previous_row_over_chunks(spark, chunk):
    data = sample(400, 1)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {
        r["id"]: (r["prev_v"], r["prev_id"])
        for r in with_previous(df, ["k"], "ts", ["v", "id"], ["id"], *chunk).collect()
    }
    want, last = {}, {}
    for k, ts, i, v in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        want[i] = last.get(k, (None, None))
        last[k] = (v, i)
    assert got == want


@pytest.mark.parametrize("chunk", [(20, 5), (100, 40), (10**6, 10**6)])
def test_row_numbers_over_chunks(spark, chunk):
    data = sample(400, 2)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["id"]: r["row"] for r in row_numbers(df, ["k"], "ts", ["id"], "row", *chunk).collect()}
    want, count = {}, {}
    for k, ts, i, v in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        count[k] = want[i] = count.get(k, 0) + 1
    assert got == want


@pytest.mark.parametrize("chunk", [(20, 5), (200, 40), (10**6, 10**6)])
def test_latest_before_over_chunks(spark, chunk):
    facts, asked = sample(300, 3), sample(200, 4, keys="abcd")
    fdf = spark.createDataFrame(facts, "k string, fts timestamp, fid long, fv long")
    rdf = spark.createDataFrame(asked, SCHEMA)
    found = latest_before(rdf, fdf, ["k"], "ts", "fts", ["fid"], *chunk).collect()
    assert len(found) == len(asked)
    for r in found:
        past = [f for f in facts if f[0] and f[0] == r["k"] and f[1] <= r["ts"]]
        want = max(past, key=lambda f: (f[1], f[2]))[2] if past else None
        assert (r["fact"]["fid"] if r["fact"] else None) == want


@pytest.mark.parametrize("chunk", [(20, 5), (10**6, 10**6)])
def test_a_hot_null_key_loses_no_row(spark, chunk):
    data = [(None if i % 2 else "a", T0 + timedelta(seconds=i), i, i) for i in range(100)]
    df = spark.createDataFrame(data, SCHEMA)
    numbered = row_numbers(df, ["k"], "ts", ["id"], "row", *chunk).collect()
    assert sorted((r["k"] or "", r["row"]) for r in numbered) == sorted(
        (k, n) for k in ("", "a") for n in range(1, 51)
    )
    before = {r["id"]: r["prev_id"] for r in with_previous(df, ["k"], "ts", ["id"], ["id"], *chunk).collect()}
    assert before == {i: i - 2 if i > 1 else None for i in range(100)}


@pytest.mark.parametrize("chunk", [(20, 5), (100, 40), (10**6, 10**6)])
def test_running_totals_over_chunks(spark, chunk):
    data = sample(400, 6)
    df = spark.createDataFrame(data, SCHEMA)
    found = running_totals(df, ["k"], ["ts", "id"], {"total": "v"}, {"mixed": F.xxhash64("id")}, *chunk)
    got = {r["id"]: (r["total"], r["mixed"]) for r in found.collect()}
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    want, state = {}, {}
    for k, ts, i, v in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        total, mixed = state.get(k, (0, 0))
        state[k] = want[i] = (total + v, mixed ^ hashes[i])
    assert got == want and found.columns == ["k", "ts", "id", "v", "total", "mixed"]


def test_rows_of_one_instant_are_split(spark):
    """A key whose rows share their instant, and even all values, is cut into chunks of equal size."""
    data = [("a", T0, 7, 1)] * 1000 + [("a", T0 + timedelta(seconds=1), 8, 2), ("b", T0, 1, 1)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    hot = hot_keys(df, ["k"], 100)
    sizes = _chunked(df, ["k"], ["ts", "id"], hot, 50).groupBy("k", "_chunk").count().collect()
    assert sum(r["count"] for r in sizes) == 1002
    assert max(r["count"] for r in sizes) <= 200 and sum(r["k"] == "a" for r in sizes) >= 10
    numbered = row_numbers(df, ["k"], "ts", ["id"], "row", 100, 50).collect()
    assert sorted(r["row"] for r in numbered if r["k"] == "a") == list(range(1, 1002))
    assert [r["row"] for r in numbered if r["id"] == 8] == [1001]
    totals = running_totals(df, ["k"], ["ts", "id"], {"total": "v"}, None, 100, 50).collect()
    assert sorted(r["total"] for r in totals if r["k"] == "a") == [*range(1, 1001), 1002]
    facts = spark.createDataFrame([("a", T0, 1, 5)] * 300, "k string, fts timestamp, fid long, fv long")
    found = latest_before(df, facts, ["k"], "ts", "fts", ["fid"], 100, 50).collect()
    assert len(found) == 1002 and all((r["fact"] is not None) == (r["k"] == "a") for r in found)


def test_no_window_over_a_whole_key_of_raw_rows(spark):
    """With a hot key, windows over raw rows are partitioned by chunk as well."""
    df = spark.createDataFrame(sample(100, 5), SCHEMA)
    plan = with_previous(df, ["k"], "ts", ["v"], (), 10, 5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [lag" in line]
    assert windows and all("_chunk" in line for line in windows)
