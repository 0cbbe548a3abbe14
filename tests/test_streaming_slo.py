"""Error ratios kept by micro-batches against the batch operator on all buckets."""

import random
from datetime import datetime, timedelta

import pytest

from driftline.operators import slo
from driftline.streaming import slo as live

T0 = datetime(2024, 3, 1)
MINUTES = timedelta(minutes=5)
WINDOWS = {"5m": 300, "1h": 3600, "1d": 86_400}
PERIOD = 3 * 86_400
SCHEMA = "service string, zone string, ts timestamp, bad long, total long"
LABELS = ["service", "zone"]


def ratios(df):
    out = {}
    for r in df.collect():
        key = (r["service"], r["zone"], r["ts"])
        assert key not in out
        out[key] = tuple(None if r[c] is None else round(r[c], 9) + 0.0 for c in ("ratio_5m", "ratio_1h", "ratio_1d", "ratio_period"))
    return out


def batch_answer(spark, buckets):
    rows = [(*k, *v) for k, v in buckets.items()]
    return ratios(slo.error_ratios(spark.createDataFrame(rows, SCHEMA), LABELS, windows=WINDOWS, period=PERIOD))


def some_batches(seed):
    """Five batches of changed buckets: gaps, late changes, null labels, a series that ends and one that comes late."""
    rng = random.Random(seed)
    series = [("a", "x"), ("a", None), (None, None), ("gone", "x"), ("new", "y")]
    buckets, batches = {}, []
    for n in range(5):
        changed = {}
        for s in series:
            if (s[0] == "gone" and n > 0) or (s[0] == "new" and n < 3):
                continue
            for i in range(n * 60, n * 60 + 60):
                if rng.random() < 0.4:
                    total = rng.randrange(1, 9)
                    changed[(*s, T0 + i * MINUTES * 5)] = (rng.randrange(total + 1), total)
            if n and s[0] == "a":  # a late row before the end of the batch before, and an update
                late = (*s, T0 + (n * 60 - 2) * MINUTES * 5 + MINUTES)
                changed[late] = (0, 3)
                known = max(k for k in buckets if k[:2] == s)
                changed[known] = (buckets[known][0], buckets[known][1] + 1)
        buckets.update(changed)
        batches.append(changed)
    return batches


def test_every_batch_gives_what_the_batch_operator_gives(spark, tmp_path):
    path, buckets = str(tmp_path), {}
    write = live.live_ratios(path, LABELS, windows=WINDOWS, period=PERIOD)
    for number, changed in enumerate(some_batches(4)):
        buckets.update(changed)
        df = spark.createDataFrame([(*k, *v) for k, v in changed.items()], SCHEMA)
        write(df, number)
        if number in (1, 4):
            write(df, number)  # run again after a failure
            assert ratios(live.current_ratios(spark, path, LABELS, WINDOWS)) == batch_answer(spark, buckets)
    write(spark.createDataFrame([], SCHEMA), 5)
    assert len(ratios(live.current_ratios(spark, path, LABELS, WINDOWS))) > 500


def test_a_series_that_returns_after_all_windows(spark, tmp_path):
    path, buckets = str(tmp_path), {}
    write = live.live_ratios(path, LABELS, windows=WINDOWS, period=PERIOD)
    days = timedelta(days=1)
    for number, (name, at) in enumerate([("a", T0), ("b", T0 + 5 * days), ("a", T0 + 6 * days)]):
        changed = {(name, None, at): (1, 2)}
        buckets.update(changed)
        write(spark.createDataFrame([(*k, *v) for k, v in changed.items()], SCHEMA), number)
    assert ratios(live.current_ratios(spark, path, LABELS, WINDOWS)) == batch_answer(spark, buckets)


def test_a_batch_reads_only_the_days_one_window_before(spark, tmp_path):
    path = str(tmp_path)
    write = live.live_ratios(path, ["service"], windows=WINDOWS, period=PERIOD)
    schema = "service string, ts timestamp, bad long, total long"
    for number in range(10):
        write(spark.createDataFrame([("a", T0 + timedelta(days=number, hours=12), 1, 4)], schema), number)
    noon = int((T0 + timedelta(days=10, hours=12) - datetime(1970, 1, 1)).total_seconds()) // 86_400
    for day in (noon - 10, noon - 9, noon - 6, noon - 5):
        with open(f"{path}/steps/day={day}/batch=0.parquet", "wb") as broken:
            broken.write(b"not a table")
    write(spark.createDataFrame([("a", T0 + timedelta(days=10, hours=12), 1, 4)], schema), 10)
    with pytest.raises(Exception):
        live.current_ratios(spark, path, ["service"], WINDOWS).collect()
