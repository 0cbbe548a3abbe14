import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.errors import (
    EmptyDataError,
    InsufficientDataError,
    InvalidUrlError,
    MissingColumnError,
    RegistrationError,
    SourceError,
    ThresholdError,
)
from driftline.operators import asof, cost, inventory, loadtest, logs, registry
from driftline.sources import files, intake

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


# --- sources ------------------------------------------------------------------


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_cells_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [(1, 'x "q" y'), (2, "two\nlines, and a comma"), (3, " blanks "), (4, 'ends with "')]
    path = str(tmp_path / "quoted")
    files.write_csv(spark.createDataFrame(rows, "a long, b string"), path)
    assert sorted(tuple(r) for r in files.read_csv_table(spark, path, "a long, b string").collect()) == rows
    single = write(tmp_path / "one.csv", 'a,b\n1,"x ""q"" y"\n2,"two\nlines"\n')
    lenient = files.read_csv_table(spark, single, "a long, b string", strict=False)
    assert [r["b"] for r in lenient.orderBy("a").collect()] == ['x "q" y', "two\nlines"]
    assert files.malformed_rows(lenient).count() == 0


def test_a_file_without_lines_is_counted(spark, tmp_path):
    write(tmp_path / "none.txt", "")
    write(tmp_path / "three.txt", "a\nb\nc\n")
    found = {r["path"].rsplit("/", 1)[1]: (r["lines"], r["enough"]) for r in files.line_counts(spark, str(tmp_path)).collect()}
    assert found == {"none.txt": (0, False), "three.txt": (3, True)}


def test_csv_errors_are_told_apart(spark, tmp_path):
    schema = "a int, b double, c string"
    with pytest.raises(SourceError):
        files.read_csv_table(spark, str(tmp_path / "none.csv"), schema)
    with pytest.raises(EmptyDataError):
        files.read_csv_table(spark, write(tmp_path / "empty.csv", "a,b,c\n"), schema)
    bad = write(tmp_path / "bad.csv", "a,b,c\n1,2.0,x\n1,2\n1,2.0,x,y\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv_table(spark, bad, schema, check_empty=False).collect()
    lenient = files.read_csv_table(spark, bad, schema, strict=False)
    assert lenient.count() == 3 and files.malformed_rows(lenient).count() == 2


def test_na_tokens_are_null(spark, tmp_path):
    path = write(tmp_path / "na.csv", "a,b\n1,x\nNA,null\n,N/A\nnan,ok\n")
    df = files.read_csv_table(spark, path, "a double, b string")
    assert [tuple(r) for r in df.collect()] == [(1.0, "x"), (None, None), (None, None), (None, "ok")]


@pytest.mark.parametrize(
    "url, reason",
    [
        ("https://files.test.invalid/iris.csv", None),
        ("http://files.test.invalid/iris.csv", None),
        ("ftp://files.test.invalid/iris.csv", "unsupported scheme"),
        ("files.test.invalid/iris.csv", "invalid format"),
        ("https:///iris.csv", "invalid format"),
        ("", "invalid format"),
        (None, "invalid format"),
    ],
)
def test_urls(spark, url, reason):
    df = spark.createDataFrame([(url,)], "url string")
    row = intake.check_urls(df, "url").first()
    assert row["reason"] == reason and row["valid"] is (reason is None)
    if reason:
        with pytest.raises(InvalidUrlError):
            intake.valid_source_urls(df, "url", strict=True)


def test_encodings_of_files(spark, tmp_path):
    folder = tmp_path / "enc"
    folder.mkdir()
    write(folder / "u.txt", "naïve €")
    write(folder / "w.txt", "naïve €", "cp1252")
    (folder / "l.txt").write_bytes(b"a\x81b" + b"x" * 100_000)
    # The byte that is not UTF-8 comes after the first 64 K: the whole file counts.
    (folder / "late.txt").write_bytes(b"x" * 100_000 + b"\xe9")
    found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in files.detect_encoding(spark, str(folder)).collect()}
    assert found == {"u.txt": "utf-8", "w.txt": "cp1252", "l.txt": "iso-8859-1", "late.txt": "cp1252"}


def test_line_gate(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    write(folder / "a.txt", "1\n2\n3\n")
    files.min_lines_gate(spark, str(folder))
    write(folder / "b.txt", "only one\n")
    with pytest.raises(InsufficientDataError, match="b.txt"):
        files.min_lines_gate(spark, str(folder))


def test_step_cache(spark):
    manifest = spark.createDataFrame(
        [("k1", "old", T0), ("k1", "new", T0 + 30 * HOUR), ("k2", "stale", T0)],
        "key string, output string, created_at timestamp",
    )
    steps = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    as_of = F.lit("2024-01-02 07:00:00").cast("timestamp")
    found = {r["key"]: (r["output"], r["reuse"]) for r in intake.reusable_steps(steps, manifest, as_of).collect()}
    assert found == {"k1": ("new", True), "k2": (None, False), "k3": (None, False)}


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS v")
    a = intake.dataset_fingerprint(df).first()
    assert a == intake.dataset_fingerprint(df.repartition(9).select("v", "id")).first()
    assert a != intake.dataset_fingerprint(df.filter("id <> 3")).first()


def test_diff_counts_copies(spark):
    old = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    new = spark.createDataFrame([(1,), (3,), (3,)], "a int")
    found = {tuple(r) for r in intake.dataset_diff(old, new).collect()}
    assert found == {("removed", 1, 1), ("removed", 1, 2), ("added", 2, 3)}


def test_relabel_keeps_target_without_match(spark):
    df = spark.createDataFrame([("10.0.0.1", "x"), ("", "y")], "ip string, addr string")
    out = intake.relabel(df, [intake.Rule(("ip",), "(.+)", target="addr", replacement="$1:8082")])
    assert [r["addr"] for r in out.collect()] == ["10.0.0.1:8082", "y"]


# --- feature views ------------------------------------------------------------

VIEW = asof.FeatureView("v", ("k",), {"x": "float"}, timestamp="ts")


def test_point_in_time(spark):
    day = timedelta(days=1)
    features = spark.createDataFrame(
        [(1, T0, 1.0), (1, T0 + day, 2.0), (1, T0 + 3 * day, 3.0)], "k long, ts timestamp, x double"
    )
    asked = [
        (1, T0 - HOUR, None),
        (1, T0, 1.0),
        (1, T0 + 2 * day, 2.0),
        (1, T0 + 10 * day, 3.0),
        (1, T0 + 10 * day + HOUR, None),  # older than the time to live
        (2, T0, None),
    ]
    entities = spark.createDataFrame([(k, t) for k, t, _ in asked], "k long, event_timestamp timestamp")
    found = asof.historical_features(entities, [(VIEW, features)], ["v:x"]).collect()
    assert sorted(map(tuple, found), key=str) == sorted(asked, key=str)


def test_unknown_reference(spark):
    with pytest.raises(MissingColumnError):
        asof.refs_of(VIEW, ["v:nope"])
    assert asof.refs_of(VIEW, ["other:a", "v:x"]) == ["x"]
    with pytest.raises(MissingColumnError):
        VIEW.shape(spark.range(1))


# --- load tests ---------------------------------------------------------------


def test_summary_excludes_failures(spark):
    results = spark.createDataFrame(
        [(4, 0.1, 5.0, 100, True, None), (4, 9.0, 9.0, 999, False, "boom" * 100)],
        "concurrency int, ttft_s double, total_s double, output_tokens int, ok boolean, error string",
    )
    walls = spark.createDataFrame([(4, 5.0)], "concurrency int, wall_s double")
    row = loadtest.benchmark_summary(results, walls).first()
    assert (row["requests"], row["ok"], row["errors"]) == (2, 1, 1)
    assert row["aggregate_tokens_per_s"] == 20.0 and row["total_output_tokens"] == 100
    assert row["latency_p95_s"] == 5.0 and row["per_request_tokens_per_s_median"] == 20.0
    assert len(loadtest.first_errors(results, "concurrency", "total_s").first()["first_error"]) == 400
    cut = loadtest.first_errors(results, "concurrency", "total_s", length=200)
    assert len(cut.first()["first_error"]) == 200
    line = loadtest.report_lines(loadtest.benchmark_summary(results, walls), 0.72).first()["line"]
    assert line.startswith("| 4 | 1/1 | 0.1s |") and line.count("|") == loadtest.REPORT_HEADER.count("|")


def test_level_without_success(spark):
    results = spark.createDataFrame(
        [(1, 0.0, 1.0, 0, False)], "concurrency int, ttft_s double, total_s double, output_tokens int, ok boolean"
    )
    walls = spark.createDataFrame([(1, 0.0)], "concurrency int, wall_s double")
    row = loadtest.benchmark_summary(results, walls).first()
    assert row["ttft_p50_s"] == 0 and row["aggregate_tokens_per_s"] == 0


def test_cost_per_million(spark):
    df = spark.createDataFrame([(1000.0,), (0.0,)], "t double")
    assert [r[0] for r in df.select(loadtest.cost_per_mtok(F.col("t"), 0.72)).collect()] == [0.2, 0.0]


# --- registry -----------------------------------------------------------------


def test_registration(spark):
    runs = spark.createDataFrame(
        [("m", "a", {"accuracy": 0.9}), ("m", "b", {"accuracy": 0.89}), ("m", "c", {"f1": 1.0})],
        "model string, run_id string, metrics map<string,double>",
    )
    found = [r["decision"] for r in registry.registration_gate(runs, 0.9).collect()]
    assert found == ["registered", "below_threshold", "missing_metric"]
    with pytest.raises(RegistrationError):
        registry.registration_gate(runs, 0.9, strict=True)
    for wrong in (-0.1, 1.1):
        with pytest.raises(ThresholdError):
            registry.registration_gate(runs, wrong)


def test_alias(spark):
    versions = spark.createDataFrame(
        [("m", 1, "r1", "s3://a"), ("m", 2, "r2", "artifacts:/b"), ("n", 1, "r3", "gs://c")],
        "model string, version int, run_id string, source string",
    )
    aliases = spark.createDataFrame(
        [("m", "champion", 2), ("m", "old", 1), ("n", "champion", 1), ("n", "lost", 9)],
        "model string, alias string, version int",
    )
    runs = spark.createDataFrame([("r1", "7")], "run_id string, experiment_id string")
    found = {(r["model"], r["alias"]): (r["status"], r["experiment_id"]) for r in registry.resolve_alias(aliases, versions, runs).collect()}
    assert found == {
        ("m", "champion"): ("unfetchable", ""),
        ("m", "old"): ("resolved", "7"),
        ("n", "champion"): ("resolved", ""),
        ("n", "lost"): ("unresolved", ""),
    }


PREFIX = "gov/"
GOOD = {"model-name": "iris", "model-version": "2.1.3", "model-owner": "team", "model-stage": "production"}
LINEAGE = {"run-id": "r", "experiment-id": "1"}
APPROVED = {"approved-by": "x", "approval-date": "2026-07-11", "approval-ticket": "T-1", "accuracy": "0.90"}


def test_policies(spark):
    cases = {
        "prod-approved": (GOOD, {**LINEAGE, **APPROVED}),
        "missing-labels": (None, None),
        "bad-version": ({**GOOD, "model-version": "abc", "model-stage": "staging"}, LINEAGE),
        "prod-unapproved": ({**GOOD, "model-version": "3"}, LINEAGE),
        "staging": ({**GOOD, "model-version": "3", "model-stage": "staging"}, LINEAGE),
        "empty-owner": ({**GOOD, "model-owner": ""}, {**LINEAGE, **APPROVED}),
    }

    def prefixed(d):
        return None if d is None else {PREFIX + k: v for k, v in d.items()}

    df = spark.createDataFrame(
        [(n, prefixed(a), prefixed(b)) for n, (a, b) in cases.items()],
        "name string, labels map<string,string>, annotations map<string,string>",
    )
    found = {(r["name"], r["rule"]): r["result"] for r in registry.policy_results(df, registry.LabelNames(PREFIX)).collect()}
    order = (
        "require-model-labels",
        "require-approval-for-production",
        "require-lineage",
        "require-performance-metrics",
        "validate-version-format",
    )
    table = {n: [found[(n, rule)] for rule in order] for n in cases}
    assert table == {
        "prod-approved": ["pass"] * 5,
        "missing-labels": ["fail", "skip", "fail", "skip", "pass"],
        "bad-version": ["pass", "skip", "pass", "skip", "fail"],
        "prod-unapproved": ["pass", "fail", "pass", "fail", "pass"],
        "staging": ["pass", "skip", "pass", "skip", "pass"],
        "empty-owner": ["fail", "pass", "pass", "pass", "pass"],
    }


# --- inventory and cost -------------------------------------------------------


def test_storage_units(spark):
    df = spark.createDataFrame([("10Gi",), ("1Ti",), ("512Mi",), ("unknown",), (None,)], "q string")
    assert [r[0] for r in df.select(inventory.storage_gi(F.col("q"))).collect()] == [10.0, 0, 0, 0, 0]
    assert [r[0] for r in df.select(inventory.storage_gi(F.col("q"), True)).collect()] == [10.0, 1024.0, 0.5, 0, 0]


def test_idle_pods(spark):
    schema = (
        "namespace string, name string, phase string, "
        "conditions array<struct<last_transition:timestamp>>, containers array<struct<restarts:int>>"
    )
    old, new = T0, T0 + 30 * HOUR
    df = spark.createDataFrame(
        [
            ("n", "idle", "Running", [(old,), (None,)], [(0,)]),
            ("n", "fresh", "Running", [(old,), (new,)], [(0,)]),
            ("n", "restarted", "Running", [(old,)], [(0,), (1,)]),
            ("n", "done", "Succeeded", [(old,)], [(0,)]),
            ("n", "unknown", "Running", None, None),
            ("n", "bare", "Running", [(old,)], None),
        ],
        schema,
    )
    as_of = F.lit("2024-01-02 12:00:00").cast("timestamp")
    found = {r["resource"]: r["age_hours"] for r in inventory.idle_pods(df, as_of).collect()}
    assert found == {"n/idle": 36.0, "n/bare": 36.0}


def test_replicas_and_savings(spark):
    df = spark.createDataFrame(
        [("n", "a", 4, 4), ("n", "b", 3, 2), ("n", "c", None, None), ("n", "d", 2, 2)],
        "namespace string, name string, replicas int, ready_replicas int",
    )
    claims = spark.createDataFrame([("n", "p", "10Gi"), ("n", "q", "5Gi")], "namespace string, name string, storage string")
    pods = spark.createDataFrame([("n", ["q", "z"]), ("n", None)], "namespace string, claims array<string>")
    found = inventory.findings(inventory.overprovisioned(df), inventory.orphaned_volumes(claims, pods))
    assert {r["resource"] for r in found.collect()} == {"n/a", "n/p"}
    assert inventory.savings(found).first()[0] == 61.0
    counts = {r["severity"]: r["findings"] for r in inventory.severity_counts(found).collect()}
    assert counts == {"high": 1, "medium": 1, "low": 0, "info": 0}


def test_budget_crossings(spark):
    spend = spark.createDataFrame(
        [("s", T0.date() + timedelta(days=i), 10.0) for i in range(10)], "svc string, day date, cost double"
    )
    budgets = spark.createDataFrame([("s", 60.0)], "svc string, budget double")
    found = {r["share"]: (r["day"].day, r["spent"]) for r in cost.budget_crossings(spend, budgets, ["svc"]).collect()}
    assert found == {0.5: (3, 30.0), 0.8: (5, 50.0), 1.0: (6, 60.0)}


# --- logs ---------------------------------------------------------------------


def line(i, event, step, run="r1", **more):
    return json.dumps(
        {
            "timestamp": (T0 + timedelta(seconds=i)).isoformat() + "+00:00",
            "level": more.pop("level", "INFO"),
            "message": event,
            "correlation_id": run,
            "location": {"file": "a.py", "line": i, "function": "f"},
            "extra": {"event": event, "step": step, **more.pop("extra", {})},
            **more,
        }
    )


def test_log_lines(spark):
    data = [
        line(0, "step_start", "load"),
        line(7, "step_complete", "load", extra={"duration_seconds": 7}),
        line(8, "step_start", "train"),
        line(9, "step_error", "train", level="ERROR", extra={"error_type": "ValueError"}),
        "{not json",
    ]
    parsed = logs.parse_logs(spark.createDataFrame([(d,) for d in data], "value string"))
    assert [r["quarantine"] for r in parsed.filter("quarantine IS NOT NULL").collect()] == ["{not json"]
    steps = {r["step"]: r["seconds"] for r in logs.step_durations(parsed).collect()}
    assert steps == {"load": 7.0, "train": None}
    assert [tuple(r) for r in logs.step_errors(parsed).collect()] == [("train", "ValueError", 1)]
    assert [r["message"] for r in logs.trace(parsed, "r1").collect()][0] == "step_start"
    assert logs.traces(parsed).first()["errors"] == 1


def test_as_of_join_with_a_hot_key_matches_brute_force(spark):
    rng = random.Random(8)
    hot = lambda: 1 if rng.random() < 0.7 else rng.randrange(5)
    features = [(hot(), T0 + timedelta(seconds=rng.randrange(10**6)), float(i)) for i in range(400)]
    asked = [(hot(), T0 + timedelta(seconds=rng.randrange(10**6)), i) for i in range(300)]
    fdf = spark.createDataFrame(features, "k long, ts timestamp, x double")
    edf = spark.createDataFrame(asked, "k long, event_timestamp timestamp, id long")
    got = {r["id"]: r["x"] for r in asof.historical_features(edf, [(VIEW, fdf)], ["v:x"], hot_rows=50, chunk_rows=10).collect()}
    for k, t, i in asked:
        past = [f for f in features if f[0] == k and timedelta(0) <= t - f[1] <= timedelta(days=7)]
        assert got[i] == (max(past, key=lambda f: f[1])[2] if past else None)
