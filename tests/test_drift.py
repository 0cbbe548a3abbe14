import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftline.errors import DataError
from driftline.functions.statistics import _upper_gamma, kolmogorov_p_value
from driftline.operators import drift
from driftline.operators.drift import DriftConfig
from pyspark.sql import functions as F


def ks(a, b):
    values = np.sort(np.concatenate([a, b]))
    return np.max(
        np.abs(
            np.searchsorted(np.sort(a), values, "right") / len(a)
            - np.searchsorted(np.sort(b), values, "right") / len(b)
        )
    )


def psi_js(a, b, bins=10):
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    if lo == hi:
        return 0.0, 0.0
    edges = np.linspace(lo, hi, bins + 1)
    ha, hb = np.histogram(a, edges)[0], np.histogram(b, edges)[0]
    pa, pb = (ha + 1) / (len(a) + bins), (hb + 1) / (len(b) + bins)
    psi = float(np.sum((pb - pa) * np.log(pb / pa)))
    if a.min() == a.max() or b.min() == b.max():
        psi = 0.0
    w = (hi - lo) / bins
    da, db = ha / (len(a) * w) + 1e-10, hb / (len(b) * w) + 1e-10
    p, q = da / da.sum(), db / db.sum()
    m = (p + q) / 2
    js = 0.5 * np.sum(p * np.log(p / m)) + 0.5 * np.sum(q * np.log(q / m))
    return psi, math.sqrt(max(js, 0.0))


def sides(spark, a, b):
    return (
        spark.createDataFrame(pd.DataFrame({"x": a})),
        spark.createDataFrame(pd.DataFrame({"x": b})),
    )


def one(spark, a, b, config=DriftConfig()):
    ref, cur = sides(spark, np.asarray(a, float), np.asarray(b, float))
    return drift.detect_drift(ref, cur, config=config).first()


SAMPLES = {
    "same": lambda r: (r.normal(size=800), r.normal(size=700)),
    "shifted": lambda r: (r.normal(size=500), r.normal(3, 1, 600)),
    "tail": lambda r: (np.exp(r.normal(0, 4, 700)), np.exp(r.normal(0.2, 4, 500))),
    "ties": lambda r: (r.integers(0, 5, 900) * 1.0, r.integers(1, 6, 900) * 1.0),
    "one value in the reference": lambda r: (np.full(50, 2.0), r.normal(size=300)),
    "one value in both": lambda r: (np.full(50, 2.0), np.full(60, 2.0)),
    "two values": lambda r: (np.full(50, 2.0), np.full(60, 5.0)),
    "tiny": lambda r: (np.array([1.0]), np.array([2.0, 3.0])),
}


@pytest.mark.parametrize("name", SAMPLES)
@pytest.mark.parametrize("ranges", [3, 256])
def test_numeric_statistics(spark, name, ranges):
    """Any number of ranges gives the exact statistics."""
    a, b = SAMPLES[name](np.random.default_rng(5))
    row = one(spark, a, b, DriftConfig(min_ranges=ranges, max_ranges=ranges))
    psi, js = psi_js(a, b)
    assert row["ks_statistic"] == pytest.approx(ks(a, b), abs=1e-12)
    assert row["psi"] == pytest.approx(psi, abs=1e-9)
    assert row["js_distance"] == pytest.approx(js, abs=1e-6)
    assert row["drift_score"] == pytest.approx((ks(a, b) + js) / 2, abs=1e-6)
    assert row["ref_mean"] == pytest.approx(a.mean()) and row["cur_mean"] == pytest.approx(b.mean())


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    a=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60),
    b=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60),
)
def test_statistics_of_any_sample(spark, a, b):
    row = one(spark, a, b, DriftConfig(min_ranges=4, max_ranges=4))
    assert row["ks_statistic"] == pytest.approx(ks(np.array(a), np.array(b)), abs=1e-12)
    assert row["psi"] >= -1e-12 and 0 <= row["js_distance"] <= math.sqrt(math.log(2)) + 1e-6
    assert row["drift_score"] >= 0


def test_severity_thresholds(spark):
    df = spark.createDataFrame([(0.1,), (0.0999,), (0.05,), (0.0499,)], "s double")
    found = [r[0] for r in df.select(drift.severity(F.col("s"))).collect()]
    assert found == ["critical", "warning", "warning", "none"]


def test_large_shift_is_critical(spark):
    rng = np.random.default_rng(2)
    row = one(spark, rng.normal(0, 1, 300), rng.normal(5, 1, 300))
    assert row["severity"] == "critical" and row["is_drifted"] and row["ks_pvalue"] < 1e-6


def test_identical_sample_does_not_drift(spark):
    a = np.random.default_rng(3).normal(size=400)
    row = one(spark, a, a)
    assert row["ks_statistic"] == 0 and row["psi"] == pytest.approx(0) and row["severity"] == "none"
    assert row["ks_pvalue"] == 1.0


def test_categorical_statistics(spark):
    ref = ["a"] * 150 + ["b"] * 90 + ["c"] * 60
    cur = ["a"] * 15 + ["b"] * 15 + ["c"] * 250 + ["d"] * 20
    row = drift.detect_drift(
        spark.createDataFrame([(v,) for v in ref], "x string"),
        spark.createDataFrame([(v,) for v in cur], "x string"),
    ).first()
    r = np.array([150, 90, 60, 0]) + 1
    c = np.array([15, 15, 250, 20]) + 1
    e = r * (c.sum() / r.sum())
    chi = ((c - e) ** 2 / e).sum()
    assert row["chi_squared"] == pytest.approx(chi)
    assert row["cramers_v"] == pytest.approx(math.sqrt(chi / (600 * 2)))
    assert row["ks_statistic"] == pytest.approx(chi / (chi + 300))
    assert row["psi"] == 0 and row["kind"] == "categorical" and row["ks_pvalue"] < 1e-9


def test_single_category_scores_zero(spark):
    df = spark.createDataFrame([("a",)] * 20, "x string")
    assert drift.detect_drift(df, df).first()["drift_score"] == 0


def test_booleans_count_as_numbers(spark):
    ref = spark.createDataFrame([(True,), (False,)] * 10, "x boolean")
    cur = spark.createDataFrame([(True,)] * 20, "x boolean")
    row = drift.detect_drift(ref, cur).first()
    assert row["kind"] == "numeric" and row["ks_statistic"] == 0.5


def test_skipped_features(spark):
    ref = spark.createDataFrame([(1.0, 2.0, None, "a")], "x double, y double, z double, w string")
    cur = spark.createDataFrame([(1.0, None, 3.0)], "x double, y double, z double")
    found = {r["feature"]: r["status"] for r in drift.skipped_features(ref, cur).collect()}
    assert found == {
        "w": "skipped_missing_in_current",
        "y": "skipped_empty_current",
        "z": "skipped_empty_reference",
    }
    assert [r["feature"] for r in drift.detect_drift(ref, cur).collect()] == ["x"]


def test_nan_is_no_value(spark):
    ref = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    cur = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    row = drift.detect_drift(ref, cur).first()
    assert (row["n_ref"], row["n_cur"], row["ks_statistic"]) == (2, 2, 0.0)


def test_reference_is_needed(spark):
    with pytest.raises(DataError):
        drift.detect_drift(None, spark.range(1))


def test_report_texts(spark):
    def text(scores):
        df = spark.createDataFrame([(s, s >= 0.05) for s in scores], "drift_score double, is_drifted boolean")
        return drift.drift_report(df).first()["recommendation"]

    assert text([0.3, 0.0]).startswith("CRITICAL: Significant drift detected in 1/2 features (50.0%).")
    assert text([0.06, 0.06]).startswith("WARNING: Moderate drift detected in 2/2 features (100.0%).")
    assert text([0.01]).startswith("OK: No significant drift detected. 1 features analyzed.")


def test_no_features_gives_an_empty_report(spark):
    found = drift.detect_drift(spark.range(1).select("id"), spark.range(1).selectExpr("'a' AS other"))
    report = drift.drift_report(found).first()
    assert report["features_analyzed"] == 0 and report["overall_drift_score"] == 0


@pytest.mark.parametrize(
    "dof, x, want",
    [(1, 3.841458820694124, 0.05), (2, 5.991464547107979, 0.05), (10, 18.307038053275146, 0.05), (3, 0.0, 1.0)],
)
def test_chi_squared_tail(dof, x, want):
    assert _upper_gamma(dof / 2, x / 2) == pytest.approx(want, abs=1e-9)


def test_kolmogorov_tail(spark):
    """Critical value 1.358 of the limit distribution belongs to p = 0.05."""
    df = spark.createDataFrame([(1.3580986393225505 / math.sqrt(50.0),)], "d double")
    p = df.select(kolmogorov_p_value(F.col("d"), F.lit(100), F.lit(100))).first()[0]
    assert p == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("name", ["tail", "ties", "one value in the reference", "one value in both", "tiny"])
def test_stored_reference(spark, name):
    """A stored profile gives the statistics that the reference itself gives."""
    a, b = SAMPLES[name](np.random.default_rng(6))
    config = DriftConfig(min_ranges=5, max_ranges=5)
    ref, cur = sides(spark, a, b)
    profile = drift.store_profile(ref, config=config)
    row = drift.drift_against(drift.open_profile(spark, profile.path), cur, config).first()
    psi, js = psi_js(a, b)
    assert row["ks_statistic"] == pytest.approx(ks(a, b), abs=1e-12)
    assert row["psi"] == pytest.approx(psi, abs=1e-9)
    assert row["js_distance"] == pytest.approx(js, abs=1e-6)
    assert row["ref_mean"] == pytest.approx(a.mean()) and row["n_ref"] == len(a) and row["n_cur"] == len(b)


def mixed(spark, seed, n):
    rng = np.random.default_rng(seed)
    rows = [
        (float(rng.normal(seed)), float("nan") if i % 7 == 0 else float(i % 11), int(i % 3), None,
         None if i % 5 == 0 else "abc"[i % (2 + seed)], i % 2 == 0, float(np.exp(rng.normal(0, 5))))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "x double, y double, k int, none double, c string, flag boolean, tail double")


def by_feature(df):
    return {r["feature"]: r.asDict() for r in df.collect()}


def test_stored_reference_of_many_columns(spark):
    ref, cur = mixed(spark, 0, 900), mixed(spark, 1, 200)
    config = DriftConfig(min_ranges=16, max_ranges=16)
    profile = drift.store_profile(ref, config=config)
    got, want = by_feature(drift.drift_against(profile, cur, config)), by_feature(drift.detect_drift(ref, cur, config=config))
    assert got.keys() == want.keys() == {"x", "y", "k", "c", "flag", "tail"}
    for feature, row in got.items():
        assert row == pytest.approx(want[feature], abs=1e-9, nan_ok=True), feature
    # Columns that a batch lacks give no row; the others stay.
    fewer = by_feature(drift.drift_against(profile, cur.drop("y", "c"), config))
    assert fewer.keys() == {"x", "k", "flag", "tail"} and fewer["tail"] == pytest.approx(got["tail"], abs=1e-9, nan_ok=True)
    nothing = drift.drift_against(profile, cur.limit(0), config)
    assert nothing.count() == 0 and nothing.columns == drift.detect_drift(ref, cur).columns


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_cuts_stay_in_their_table(spark, monkeypatch):
    """No cut is a literal of the plan, and an open range with many values is split by row rank."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=4000), rng.normal(0.05, 1, 4000)
    ref, cur = sides(spark, a, b)
    made, read = [], []
    write = drift.materialise
    monkeypatch.setattr(drift, "materialise", lambda df, label: made.append((label, plan_of(df))) or write(df, label))
    totals = drift.running_totals
    monkeypatch.setattr(
        drift, "running_totals",
        lambda df, keys, order, sums, xors, hot: read.append(df.count()) or totals(df, keys, order, sums, xors, 50, 20),
    )
    row = drift.detect_drift(ref, cur, config=DriftConfig(min_ranges=8, max_ranges=8)).first()
    assert row["ks_statistic"] == pytest.approx(ks(a, b), abs=1e-12) and read[0] > 200
    cells = [plan for label, plan in made if label in ("cells", "open-values")]
    assert len(cells) == 2 and all("scalar-subquery" in plan for plan in cells)
    measured = drift._measured(drift._wide(ref, cur, ["x"]), ["x"])
    known, ranges = drift._with_cuts(measured, DriftConfig(min_ranges=8, max_ranges=8), 1)
    assert ranges == 8
    for cut in known.first()["cuts"]:
        assert not any(str(cut)[:8] in plan for plan in cells)


def test_a_batch_does_not_read_the_reference(spark, tmp_path, monkeypatch):
    ref, cur = mixed(spark, 0, 300), mixed(spark, 1, 100)
    ref.write.parquet(f"{tmp_path}/reference")
    profile = drift.store_profile(spark.read.parquet(f"{tmp_path}/reference"), path=f"{tmp_path}/profile")
    seen = []
    write = drift.materialise
    monkeypatch.setattr(drift, "materialise", lambda df, label: seen.extend(df.inputFiles()) or write(df, label))
    found = drift.drift_against(profile, cur)
    seen += found.inputFiles()
    assert found.count() == 6
    assert any(f"{tmp_path}/profile/ranges" in file for file in seen)
    assert not any(f"{tmp_path}/reference" in file for file in seen)
