"""A missing key or label is a group like any other: it equals a missing one, and nothing else."""

from datetime import datetime

from driftline.operators import alerts, asof, loadtest, model, series, slo
from driftline.sources import intake

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(spark):
    kind = "a string, b string, value double"
    left = spark.createDataFrame([("x", None, 6.0), (None, None, 8.0), ("x", "y", 1.0), (None, "z", 5.0)], kind)
    right = spark.createDataFrame([("x", None, 2.0), (None, None, 4.0), ("q", None, 3.0)], kind)
    return left, right


def test_arithmetic_between_vectors(spark):
    left, right = vectors(spark)
    want = [("x", None, 3.0), (None, None, 2.0)]
    assert rows(series.vector_op(left, right, ["a", "b"], series.divide)) == sorted(want, key=str)
    assert rows(series.vector_op_ignoring(left, right, [], series.divide)) == sorted(want, key=str)
    one = spark.createDataFrame([(None, 10.0), ("x", 100.0)], "a string, value double")
    many = series.group_left(left, one, ["a"], lambda v, w: v * w)
    assert rows(many) == sorted(
        [("x", None, 600.0), (None, None, 80.0), ("x", "y", 100.0), (None, "z", 50.0)], key=str
    )
    alone = spark.createDataFrame([(2.0,)], "value double")
    assert rows(series.vector_op(alone, alone, [], series.divide)) == [(1.0,)]


def test_sets_of_vectors(spark):
    left, right = vectors(spark)
    assert rows(series.vector_and(left, right, ["a", "b"])) == sorted([("x", None, 6.0), (None, None, 8.0)], key=str)
    both = rows(series.vector_or(left, right, ["a", "b"]))
    assert both == sorted([*map(tuple, left.collect()), ("q", None, 3.0)], key=str)


def test_a_slow_group_without_name_does_not_pass(spark):
    kind = "g string, label string, score double, latency double, error string"
    data = [(None, "a", 0.5, 9.0, None)] * 3 + [("ok", "a", 0.5, 0.1, None)] * 3
    found = {r["g"]: r for r in model.check_outputs(spark.createDataFrame(data, kind), ["g"], 1.0).collect()}
    assert found[None]["p95_latency"] == 9.0 and not found[None]["passed"]
    assert found["ok"]["passed"] and len(found) == 2


def test_a_level_without_name_keeps_its_figures(spark):
    results = spark.createDataFrame(
        [(None, 0.5, 2.0, 10, True), (None, 0.5, 2.0, 10, True), (4, 1.0, 1.0, 5, True)],
        "concurrency int, ttft_s double, total_s double, output_tokens int, ok boolean",
    )
    walls = spark.createDataFrame([(None, 4.0), (4, 1.0)], "concurrency int, wall_s double")
    found = {r["concurrency"]: r for r in loadtest.benchmark_summary(results, walls).collect()}
    row = found[None]
    assert (row["ttft_p50_s"], row["latency_p95_s"], row["aggregate_tokens_per_s"], row["wall_clock_s"]) == (0.5, 2.0, 5.0, 4.0)
    assert len(found) == 2


def test_a_warning_without_namespace_is_inhibited(spark):
    kind = "alertname string, namespace string, severity string, ts timestamp"
    data = [("a", None, "critical", T0), ("a", None, "warning", T0), ("a", "n", "warning", T0), ("b", None, "warning", T0)]
    kept = rows(alerts.inhibit(spark.createDataFrame(data, kind)))
    assert [r[:3] for r in kept] == [("a", "n", "warning"), ("a", None, "critical"), ("b", None, "warning")]


def test_alerts_that_trade_a_label_are_another_set(spark):
    kind = "alertname string, namespace string, severity string, x string, y string, ts timestamp"
    later = datetime(2024, 1, 1, 0, 6)
    steps = [datetime(2024, 1, 1, 0, m) for m in range(7)]
    data = [("a", "n", "critical", "v", None, t) for t in steps if t < later] + [("a", "n", "critical", None, "v", later)]
    sent = rows(alerts.notifications(spark.createDataFrame(data, kind), wait=0, interval=60))
    assert [r[-1] for r in sent] == ["new", "changed"]


def test_tables_that_trade_a_null_differ(spark):
    a = spark.createDataFrame([("x", None)], "p string, q string")
    b = spark.createDataFrame([(None, "x")], "p string, q string")
    assert intake.dataset_fingerprint(a).first() != intake.dataset_fingerprint(b).first()
    assert intake.dataset_fingerprint(a).first() == intake.dataset_fingerprint(a.select("q", "p")).first()


def test_features_and_budgets_of_a_null_key(spark):
    view = asof.FeatureView("v", ("k",), {"f": "double"}, "ts")
    source = spark.createDataFrame([(None, T0, 1.0), ("a", T0, 2.0)], "k string, ts timestamp, f double")
    asked = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    found = {r["k"]: r["f"] for r in asof.online_features(view, source, keys=asked).collect()}
    assert found == {None: 1.0, "a": 2.0, "b": None}
    ratios = spark.createDataFrame([(None, 0.1, 0.1)], "s string, ratio_5m double, ratio_period double")
    goals = spark.createDataFrame([(None, 0.9)], "s string, objective double")
    assert abs(
        slo.burn(ratios, goals, ["s"]).first()["current_burn_rate"] - 1.0
    ) < 1e-9
