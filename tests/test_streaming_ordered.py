"""Hold and throttle over shuffled micro-batches against the rows in time order."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.sources.files import stream_source
from driftline.streaming import ordered, tables

T0 = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, service string, value double"

def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)

@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Six files whose rows are out of order by less than an hour, ties, a null label and a closing row."""
    folder = str(tmp_path_factory.mktemp("shuffled"))
    rng = random.Random(5)
    at, data = T0, []
    for _ in range(500):
        at += timedelta(seconds=rng.randrange(1, 240))
        name = rng.choice(["a", "b", None])
        data.append((at, name, rng.random() * 100))
        if rng.random() < 0.1:
            data.append((at, name, 99.0))
    data.append((None, "a", 99.0))
    mixed = sorted(data, key=lambda r: (r[0] or T0) + timedelta(minutes=rng.uniform(0, 55)))
    everything = spark.createDataFrame(data, SCHEMA)
    size = len(mixed) // 6 + 1
    for part in range(6):
        chunk = spark.createDataFrame(mixed[part * size : part * size + size], SCHEMA)
        chunk.coalesce(1).write.mode("append").parquet(folder)
    ordered.closing_rows(everything, "ts", 3600).coalesce(1).write.mode("append").parquet(folder)
    return folder, data, everything.filter("ts IS NOT NULL")

def run(spark, shuffled, build, path):
    stream = stream_source(spark, shuffled[0], shuffled[2].schema, files_per_batch=1)
    out = build(stream)
    with ordered.rocksdb(spark):
        query = tables.start_table(out, f"{path}/t", f"{path}/c")
    tables.drain(query)
    assert len(query.recentProgress) >= 6
    return spark.read.schema(out.schema).parquet(f"{path}/t")

def expected_holds(data, wanted, step):
    out = set()
    for name in {r[1] for r in data}:
        last = since = None
        for now in sorted({r[0] for r in data if r[1] == name and r[0] and r[2] > 20}):
            if last is None or now - last > step:
                since = now
            last = now
            out.add((name, now, since, "firing" if now - since >= wanted else "pending"))
    return sorted(out, key=str)

def test_hold_of_shuffled_rows(spark, shuffled, tmp_path):
    found = run(
        spark,
        shuffled,
        lambda s: ordered.hold(s, ["service"], F.col("value") > 20, 900, 420, late="1 hour"),
        str(tmp_path),
    )
    want = expected_holds(shuffled[1], timedelta(seconds=900), timedelta(seconds=420))
    assert rows(found) == want and {r[3] for r in want} == {"firing", "pending"}

@pytest.mark.parametrize("repeat", [3600, 130])
def test_throttle_of_shuffled_rows(spark, shuffled, tmp_path, repeat):
    found = run(
        spark, shuffled, lambda s: ordered.throttle(s, ["service"], repeat, late="1 hour"), str(tmp_path)
    )
    want = []
    for name in ("a", "b", None):
        sent = None
        for now in sorted(r[0] for r in shuffled[1] if r[1] == name and r[0]):
            if sent is None or now - sent >= timedelta(seconds=repeat):
                sent = now
                want.append((name, now))
    assert rows(found) == sorted(want, key=str)

class _Map(dict):
    containsKey, getValue = dict.__contains__, dict.__getitem__
    updateValue, removeKey = dict.__setitem__, dict.pop

def test_a_hot_key_is_packed_in_parts(monkeypatch):
    """More instants than fit one pack go to the state in parts, which meet again in their slot."""
    monkeypatch.setattr(ordered, "PACK", 100)
    import pandas as pd

    made = ordered._Throttle(["k"], "ts", 50, 600)
    made.parts, made.counts, woken = _Map(), _Map(), []
    made._wake = woken.append
    instants = np.random.default_rng(0).permutation(1000)
    frames = [pd.DataFrame({"_us": instants[i : i + 70]}) for i in range(0, 1000, 70)]
    assert list(made.handleInputRows(("x",), iter(frames), None)) == []
    assert sorted(woken) == list(range(20)) and max(v[0] for v in made.counts.values()) > 1
    kept = np.concatenate([np.frombuffer(v[0], np.int64) for v in made.parts.values()])
    assert sorted(kept.tolist()) == list(range(1000))
    assert max(len(v[0]) for v in made.parts.values()) <= 170 * 8

def test_repeat_must_be_positive(shuffled):
    with pytest.raises(ValueError):
        ordered.throttle(shuffled[2], ["service"], 0)

def test_empty_input_has_no_closing_row(shuffled):
    assert ordered.closing_rows(shuffled[2].limit(0), "ts", 600).count() == 0
