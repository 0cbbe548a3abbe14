"""Streams in several micro-batches against the batch operators on the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.operators import asof, drift, series, slo
from driftline.sources.files import stream_source
from driftline.streaming import drift as drift_stream
from driftline.streaming import features, monitoring, tables

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Four files of requests in time order."""
    folder = str(tmp_path_factory.mktemp("log"))
    rng = random.Random(3)
    at = T0
    data = []
    for i in range(400):
        at += timedelta(seconds=rng.randrange(1, 300))
        data.append((i, at, f"s{rng.randrange(2)}", rng.choice(["200", "500"]), rng.random() * 100))
    schema = "id long, ts timestamp, service string, status string, value double"
    for part in range(4):
        chunk = data[part * 100 : part * 100 + 100]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(data, schema)


def stream(spark, log):
    folder, batch = log
    return stream_source(spark, folder, batch.schema, files_per_batch=1)


def test_buckets_and_slo(spark, log, tmp_path):
    path = str(tmp_path)
    bad = slo.bad_status(F.col("status"))
    counted = monitoring.request_buckets(stream(spark, log), bad, ["service"])
    query = tables.drain(tables.start(counted, tables.versioned(f"{path}/t"), f"{path}/c"))
    assert len(query.recentProgress) >= 4
    kept = tables.newest(spark, f"{path}/t", ["service", "ts"])
    end = F.window("ts", "5 minutes").getField("end").alias("end")
    want = log[1].groupBy("service", end).agg(F.count_if(bad), F.count("*"))
    assert rows(kept) == rows(want)
    tables.compact(spark, f"{path}/t", ["service", "ts"], f"{path}/k")
    assert rows(spark.read.parquet(f"{path}/k").drop("batch")) == rows(want)
    ratios = slo.error_ratios(kept, ["service"])
    assert ratios.filter("ratio_3d IS NOT NULL").count() > 100


def test_restart_goes_on_where_it_stopped(spark, log, tmp_path):
    path = str(tmp_path)
    counted = monitoring.request_buckets(stream(spark, log), F.col("status") == "500", ["service"])
    for _ in range(2):
        tables.drain(tables.start(counted, tables.versioned(f"{path}/t"), f"{path}/c"))
    kept = tables.newest(spark, f"{path}/t", ["service", "ts"])
    assert kept.agg(F.sum("total")).first()[0] == 400


def test_hold_over_batches(spark, log, tmp_path):
    path = str(tmp_path)
    held = monitoring.hold(stream(spark, log), ["service"], F.col("value") > 10, 300, 600)
    tables.drain(tables.start_table(held, f"{path}/t", f"{path}/c"))
    want = series.hold(log[1], ["service"], F.col("value") > 10, 300, 600).select(
        "service", "ts", "active_since", "state"
    )
    assert rows(spark.read.schema(held.schema).parquet(f"{path}/t")) == rows(want)


def test_throttle_over_batches(spark, log, tmp_path):
    path = str(tmp_path)
    sent = monitoring.throttle(stream(spark, log), ["service"], 3600)
    tables.drain(tables.start_table(sent, f"{path}/t", f"{path}/c"))
    want, last = [], {}
    for r in sorted(log[1].collect(), key=lambda r: r["ts"]):
        previous = last.get(r["service"])
        if previous is None or r["ts"] - previous >= timedelta(hours=1):
            want.append((r["service"], r["ts"]))
            last[r["service"]] = r["ts"]
    assert rows(spark.read.schema(sent.schema).parquet(f"{path}/t")) == sorted(want, key=str)


def test_online_features(spark, log, tmp_path):
    path = str(tmp_path)
    view = asof.FeatureView("v", ("service",), {"value": "double"}, "ts", tie=("id",))
    source = stream(spark, log).select("service", "ts", "value", "id")
    tables.drain(tables.start(source, features.online_writer(view, f"{path}/t"), f"{path}/c", "append"))
    assert rows(features.read_online(spark, view, f"{path}/t")) == rows(asof.online_features(view, log[1]))


def test_drift_cycles_and_guard(spark, log, tmp_path):
    path = str(tmp_path)
    reference = log[1].filter("id < 100")
    writer = drift_stream.drift_each_cycle(reference, ["value"], "m", f"{path}/t", "ts")

    def breaks_once(batch, number):
        if number == 1:
            raise RuntimeError("no data today")
        writer(batch, number)

    guarded = tables.guarded(breaks_once, f"{path}/problems")
    tables.drain(tables.start(stream(spark, log), guarded, f"{path}/c", "append"))
    found = spark.read.parquet(f"{path}/t").filter("metric = 'drift_score'").orderBy("ts").collect()
    assert len(found) == 3  # four cycles, one of which failed
    problem = spark.read.json(f"{path}/problems").first()
    assert problem["error"] == "RuntimeError"
    last = log[1].filter("id >= 300")
    want = drift.detect_drift(reference.select("value"), last.select("value")).first()
    assert found[-1]["value"] == pytest.approx(want["drift_score"])


def test_window_counts_equal_batch(spark, log, tmp_path):
    path = str(tmp_path)
    bins = drift_stream.reference_bins(log[1].filter("id < 100"), ["value"])
    counts = drift_stream.window_counts(stream(spark, log), bins, ["value"], "6 hours")
    tables.drain(tables.start(counts, tables.versioned(f"{path}/t"), f"{path}/c"))
    kept = tables.newest(spark, f"{path}/t", ["ts", "feature", "bin"])
    want = drift_stream.window_counts(log[1], bins, ["value"], "6 hours")
    assert rows(kept) == rows(want.select("ts", "feature", "bin", "n_cur"))
    assert drift_stream.window_drift(kept, bins).filter("psi >= 0 AND js_distance >= 0").count() > 1


def test_sessions_close_after_the_gap(spark, log, tmp_path):
    path = str(tmp_path)
    sessions = monitoring.alert_sessions(stream(spark, log), ["service"], "10 minutes")
    tables.drain(tables.start_table(sessions, f"{path}/t", f"{path}/c"))
    got = spark.read.schema(sessions.schema).parquet(f"{path}/t")
    # Filtered here, not in Spark: a filter on a session's end would be moved
    # before the rows are joined into sessions.
    want = rows(monitoring.alert_sessions(log[1], ["service"], "10 minutes"))
    limit = log[1].agg(F.max("ts")).first()[0] - timedelta(minutes=10)
    assert rows(got) == [r for r in want if r[2] <= limit]


def test_steps_are_paired_across_batches(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path)
    schema = "correlation_id string, step string, event string, timestamp timestamp"
    batches = [
        [("r", "load", "step_start", T0), ("r", "train", "step_start", T0)],
        [("r", "load", "step_complete", T0 + timedelta(seconds=9))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    source = stream_source(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    paired = monitoring.step_durations(source)
    tables.drain(tables.start_table(paired, f"{path}/t", f"{path}/c"))
    got = spark.read.schema(paired.schema).parquet(f"{path}/t").collect()
    assert [(r["run"], r["step"], r["seconds"]) for r in got] == [("r", "load", 9.0)]


def test_late_rows_are_counted(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path)
    schema = "ts timestamp, service string, status string"
    days = [T0 + timedelta(days=2), T0 + timedelta(days=3), T0]
    for day in days:
        spark.createDataFrame([(day, "s", "200")], schema).coalesce(1).write.mode("append").parquet(folder)
    source = stream_source(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    counted = monitoring.request_buckets(source, F.col("status") == "500", ["service"])
    query = tables.drain(tables.start(counted, tables.versioned(f"{path}/t"), f"{path}/c"))
    total = tables.newest(spark, f"{path}/t", ["service", "ts"]).agg(F.sum("total")).first()[0]
    assert total + tables.dropped_late_rows(query) == 3 and tables.dropped_late_rows(query) == 1


@pytest.mark.parametrize("kind", ["batches", "table"])
def test_late_rows_of_more_batches_than_reports_are_kept(spark, tmp_path, kind):
    folder, path = str(tmp_path / "in"), str(tmp_path)
    schema = "ts timestamp, service string, status string"
    days = [T0 + timedelta(days=2), T0 + timedelta(days=3), T0, T0, T0] + [T0 + timedelta(days=4 + i) for i in range(4)]
    for day in days:
        spark.createDataFrame([(day, "s", "200")], schema).coalesce(1).write.mode("append").parquet(folder)
    source = stream_source(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    counted = monitoring.request_buckets(source, F.col("status") == "500", ["service"])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        if kind == "table":
            query = tables.start_table(counted, f"{path}/t", f"{path}/c")
        else:
            query = tables.start(counted, tables.versioned(f"{path}/t"), f"{path}/c")
        tables.drain(query)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    kept = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    assert kept < 3 and len(query.recentProgress) <= 2
    assert tables.dropped_late_rows(query) == 3
