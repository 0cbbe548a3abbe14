import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.functions.scalars import band
from driftline.operators import alerts, canary, series, slo

T0 = datetime(2024, 1, 1)
MIN = timedelta(minutes=1)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- series -------------------------------------------------------------------


def test_counter_reset(spark):
    values = [10, 15, 3, 3, 9]
    df = frame(spark, [("a", T0 + i * MIN, float(v)) for i, v in enumerate(values)], "k string, ts timestamp, value double")
    deltas = [r["delta"] for r in series.counter_deltas(df, ["k"]).orderBy("ts").collect()]
    assert deltas == [None, 5.0, 3.0, 0.0, 6.0]
    total = series.counter_increase(df, ["k"], 3600, 60).orderBy(F.desc("ts")).first()
    assert total["increase"] == 14.0 and total["rate"] == pytest.approx(14 / 3600)


def test_extrapolated_increase_reaches_the_window_edges(spark):
    """A counter growing 1 per 15 s sample, sampled on the grid, grows 20 in 5 minutes."""
    data = [("a", T0 + timedelta(seconds=15 * i), float(100 + i)) for i in range(1, 41)]
    df = frame(spark, data, "k string, ts timestamp, value double")
    found = series.counter_increase(df, ["k"], 300, 300, extrapolate=True).orderBy("ts").collect()
    assert found[-1]["increase"] == pytest.approx(20.0)


def test_changes(spark):
    df = frame(
        spark,
        [("a", T0 + i * MIN, v) for i, v in enumerate("xxyyx")],
        "k string, ts timestamp, value string",
    )
    assert series.changes(df, ["k"], 3600, 3600).agg(F.sum("changes")).first()[0] == 2


@pytest.mark.parametrize(
    "q, counts, want",
    [
        (0.5, [0, 10, 10, 10], 2.5),  # middle of (0..5]? rank 5 of 10 inside (0, 5]
        (0.95, [0, 0, 0, 4], 10.0),  # rank in the open bucket: last finite bound
        (0.5, [4, 4, 8, 8], 1.0),
        (0.5, [0, 0, 0, 0], None),
    ],
)
def test_histogram_quantile(spark, q, counts, want):
    bounds = F.array(*[F.lit(b) for b in (1.0, 5.0, 10.0, float("inf"))])
    got = spark.range(1).select(
        series.histogram_quantile(q, bounds, F.array(*[F.lit(c) for c in counts]))
    ).first()[0]
    if counts == [0, 10, 10, 10]:
        want = 1.0 + 4.0 * 0.5
    assert got == want


def test_trailing_sums_match_brute_force(spark):
    rng = random.Random(4)
    data = [("a", T0 + i * 5 * MIN, rng.randrange(9) if rng.random() < 0.8 else None) for i in range(60)]
    df = frame(spark, data, "k string, ts timestamp, v long")
    got = series.trailing_sums(df, ["k"], {"s3": (F.col("v"), 3), "s20": (F.col("v"), 20)})
    for i, r in enumerate(got.orderBy("ts").collect()):
        for name, n in (("s3", 3), ("s20", 20)):
            assert r[name] == sum(x[2] or 0 for x in data[max(0, i - n + 1) : i + 1])


def test_bucket_end_includes_the_boundary(spark):
    df = frame(spark, [(T0,), (T0 + timedelta(microseconds=1),)], "ts timestamp")
    found = [r[0] for r in df.select(series.bucket_end(F.col("ts"), 300)).collect()]
    assert found == [T0, T0 + 5 * MIN]


def test_hold(spark):
    data = [("a", T0 + i * MIN, v) for i, v in enumerate([1, 1, 1, 0, 1, 1])]
    data.pop(1)  # a missing evaluation breaks the run
    df = frame(spark, data, "k string, ts timestamp, v int")
    found = [
        (r["ts"], r["active_since"], r["state"])
        for r in series.hold(df, ["k"], F.col("v") == 1, 60, 60).orderBy("ts").collect()
    ]
    assert found == [
        (T0, T0, "pending"),
        (T0 + 2 * MIN, T0 + 2 * MIN, "pending"),
        (T0 + 4 * MIN, T0 + 4 * MIN, "pending"),
        (T0 + 5 * MIN, T0 + 4 * MIN, "firing"),
    ]


def test_vectors(spark):
    a = frame(spark, [("x", 1.0), ("y", 2.0)], "k string, value double")
    b = frame(spark, [("y", 4.0), ("z", 8.0)], "k string, value double")
    assert [tuple(r) for r in series.vector_op(a, b, ["k"], series.divide).collect()] == [("y", 0.5)]
    assert [r["k"] for r in series.vector_and(a, b, ["k"]).collect()] == ["y"]
    either = {r["k"]: r["value"] for r in series.vector_or(a, b, ["k"]).collect()}
    assert either == {"x": 1.0, "y": 2.0, "z": 8.0}


def test_matchers_are_anchored(spark):
    df = frame(spark, [("201",), ("2011",), ("500",), (None,)], "code string")
    assert [r[0] for r in series.matching(df, like={"code": "2.."}).collect()] == ["201"]
    assert [r[0] for r in series.matching(df, unlike={"code": "2.."}).collect()] == ["2011", "500", None]


def test_band(spark):
    df = frame(spark, [(0.05,), (0.1,), (0.25,), (None,)], "v double")
    found = [r[0] for r in df.select(band(F.col("v"), ((0.2, "red"), (0.1, "yellow")))).collect()]
    assert found == ["green", "yellow", "red", None]


# --- slo ----------------------------------------------------------------------


def test_period_ratio_is_a_mean_of_ratios(spark):
    counted = frame(
        spark,
        [("s", T0, 1, 1), ("s", T0 + 5 * MIN, 0, 99), ("s", T0 + 15 * MIN, 0, 10)],
        "slo string, ts timestamp, bad long, total long",
    )
    last = slo.error_ratios(counted, ["slo"]).orderBy(F.desc("ts")).first()
    assert last["ratio_30m"] == pytest.approx(1 / 110)
    assert last["ratio_period"] == pytest.approx(1 / 3)  # the empty step has no ratio


def test_burn_alerts(spark):
    def verdict(**ratios):
        base = {f"ratio_{w}": 0.0 for w in slo.WINDOWS} | {"budget": 0.01}
        df = spark.createDataFrame([tuple((base | ratios).values())], list(base))
        r = slo.burn_alerts(df).first()
        return r["page"], r["ticket"]

    assert verdict(ratio_5m=0.145, ratio_1h=0.145) == (True, False)
    assert verdict(ratio_5m=0.145, ratio_1h=0.144) == (False, False)
    assert verdict(ratio_30m=0.07, ratio_6h=0.07) == (True, False)
    assert verdict(ratio_2h=0.04, ratio_1d=0.04) == (False, True)
    assert verdict(ratio_6h=0.02, ratio_3d=0.02) == (False, True)


def test_bad_status(spark):
    df = frame(spark, [("200",), ("299",), ("404",), ("20",)], "s string")
    assert [r[0] for r in df.select(slo.bad_status(F.col("s"))).collect()] == [False, False, True, True]


# --- alerts -------------------------------------------------------------------


def test_every_standard_rule_fires_on_its_column(spark):
    hot = {
        "p95_seconds": 2.0, "p99_seconds": 2.0, "error_ratio": 0.06, "restarts_1h": 4, "up": 0,
        "failed_ratio_1h": 0.2, "gpu_util": 95.0, "gpu_memory_pct": 91.0, "replicas_available": 1,
        "replicas_wanted": 2, "volume_pct": 86.0, "cert_seconds_left": 604_799.0,
        "policy_failures_1h": 1, "accuracy_drop": 0.06, "accuracy_gap": 0.2, "throughput_drop": 0.4,
        "latency_growth": 0.6, "confidence": 0.6, "in_flight": 101, "cost_growth": 0.6,
        "memory_ratio": 0.95, "node_memory_free_ratio": 0.05, "db_connections": 81, "pending": 1,
        "scaler_errors_5m": 1, "failed_runs": 1,
    }
    data = [("s", T0 + i * MIN, *hot.values()) for i in range(61)]
    df = spark.createDataFrame(data, ["service", "ts", *hot])
    found = alerts.evaluate(df, alerts.STANDARD_RULES, ["service"], 60)
    firing = {r["alertname"]: r["n"] for r in found.filter("state = 'firing'").groupBy("alertname").agg(F.count("*").alias("n")).collect()}
    for rule in alerts.STANDARD_RULES:
        if rule.name == "LowGpuUtilisation":
            assert rule.name not in firing
        else:
            assert firing[rule.name] == 61 - rule.hold // 60
    assert alerts.applicable(alerts.STANDARD_RULES, df.select("service", "ts", "up"))[0].name == "ServiceDown"


def test_routing_and_inhibition(spark):
    df = frame(
        spark,
        [("A", "n", "critical", T0), ("A", "n", "warning", T0), ("A", "n", "warning", T0 + MIN),
         ("A", "m", "warning", T0), ("Watchdog", "n", "critical", T0), ("B", "n", "info", T0)],
        "alertname string, namespace string, severity string, ts timestamp",
    )
    left = {(r["alertname"], r["namespace"], r["severity"], r["ts"]) for r in alerts.inhibit(df).collect()}
    assert ("A", "n", "warning", T0) not in left and len(left) == 5
    routed = {(r[0], r[1]): r[2] for r in df.select("alertname", "severity", alerts.receiver(F.col("alertname"), F.col("severity"))).collect()}
    assert routed[("Watchdog", "critical")] == "null" and routed[("A", "critical")] == "critical-alerts"
    assert routed[("A", "warning")] == "warning-alerts" and routed[("B", "info")] == "null"


def brute_notifications(instants, step, wait, interval, repeat):
    """Replays the router over {second: set of alerts} of one group."""
    sent, runs, current = [], [], []
    for t in sorted(instants):
        if current and t - current[-1] > step:
            runs.append(current)
            current = []
        current.append(t)
    runs.append(current)
    for run in runs:
        flushes = {}
        for t in run:
            age = t - run[0] - wait
            flushes[0 if age <= 0 else math.ceil(age / interval)] = instants[t]
        last_set, last_sent = None, None
        for f in sorted(flushes):
            at = run[0] + wait + f * interval
            if last_set is None:
                reason = "new"
            elif flushes[f] != last_set:
                reason = "changed"
            elif at - last_sent >= repeat:
                reason = "repeat"
            else:
                reason = None
            if reason:
                sent.append((at, reason))
                last_sent = at
            last_set = flushes[f]
    return sent


def test_notifications_against_replay(spark):
    rng = random.Random(6)
    instants, rows_ = {}, []
    for minute in range(0, 900):
        if minute // 100 % 3 == 2:
            continue
        alerts_now = {"p1"} | ({"p2"} if rng.random() < 0.1 or 300 < minute < 330 else set())
        instants[minute * 60] = frozenset(alerts_now)
        rows_ += [("A", "n", "warning", p, T0 + minute * MIN) for p in alerts_now]
    df = frame(spark, rows_, "alertname string, namespace string, severity string, pod string, ts timestamp")
    got = alerts.notifications(df, step_seconds=60, repeat=3600, fingerprint=("pod",)).orderBy("sent_at").collect()
    want = brute_notifications(instants, 60, 30, 300, 3600)
    assert [((r["sent_at"] - T0).total_seconds(), r["reason"]) for r in got] == want


# --- canary -------------------------------------------------------------------


def measured(spark, triples):
    data = [("r", i, T0 + (i + 1) * MIN, *t, False) for i, t in enumerate(triples)]
    return spark.createDataFrame(
        data, ["run", "measurement", "at", "success-rate", "latency-p95", "error-rate", "no_traffic"]
    )


def test_recorded_rollback(spark):
    """All requests fail: the error rate ends the run after two measurements."""
    taken = canary.measurements(measured(spark, [(0.0, 9.6, 1.0), (0.0, 9.4, 1.0), (0.0, 9.0, 1.0)]), ["run"])
    assert taken.count() == 6
    verdicts = canary.metric_verdicts(taken, ["run"])
    phases = {r["metric"]: (r["phase"], r["failed"]) for r in verdicts.collect()}
    assert phases == {
        "success-rate": ("Successful", 2),
        "latency-p95": ("Successful", 0),
        "error-rate": ("Failed", 2),
    }
    run = canary.run_verdicts(verdicts, ["run"], F.first(F.lit("s3://champion"))).first()
    assert run["phase"] == "Failed" and run["action"] == "rollback"
    assert run["message"] == 'Metric "error-rate" assessed Failed due to failed (2) > failureLimit (1)'
    assert canary.run_verdicts(verdicts, ["run"]).first()["action"] == "fail"


def test_healthy_canary_is_kept(spark):
    taken = canary.measurements(measured(spark, [(0.99, 100.0, 0.01)] * 5), ["run"])
    assert taken.count() == 15
    assert canary.run_verdicts(canary.metric_verdicts(taken, ["run"]), ["run"]).first()["action"] == "keep"


def test_measurement_grid_and_empty_window(spark):
    runs = frame(spark, [("r", "svc", T0)], "run string, service string, started_at timestamp")
    grid = canary.measurement_grid(runs)
    assert [r["at"] for r in grid.orderBy("measurement").collect()] == [T0 + (i + 1) * MIN for i in range(5)]
    log = frame(
        spark,
        [("svc", T0 - MIN, True, 3.0), ("svc", T0 - MIN + timedelta(seconds=1), False, 3.0), ("svc", T0 + MIN, True, 3.0)],
        "service string, ts timestamp, ok boolean, ms double",
    )
    found = canary.measure(grid, log, ["service"], F.col("ok"), "ms", [1.0, 10.0], ["run"]).orderBy("measurement").collect()
    assert found[0]["success-rate"] == 0.5  # the left edge of the window is open
    assert found[0]["no_traffic"] is False and found[4]["no_traffic"] is True
    assert (found[4]["success-rate"], found[4]["error-rate"], found[4]["latency-p95"]) == (0.0, 0.0, 0.0)


def test_next_traffic(spark):
    df = frame(spark, [(10,), (25,), (50,), (100,), (7,)], "share int")
    assert [r[0] for r in df.select(canary.next_traffic(F.col("share"))).collect()] == [25, 50, 100, 100, None]
