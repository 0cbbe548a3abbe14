import numpy as np
import pandas as pd
import pytest

from driftline.functions.order_stats import (
    FLOOR_INDEX,
    LINEAR,
    NEAREST_EVEN,
    exact_quantiles,
)

PROBS = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]


def expected(values, p, method):
    ordered = np.sort(values)
    n = len(ordered)
    if method == LINEAR:
        return float(np.quantile(ordered, p))
    if method == NEAREST_EVEN:
        return ordered[max(0, min(n - 1, round(p * (n - 1))))]
    return ordered[min(int(p * n), n - 1)]


@pytest.mark.parametrize("method", [LINEAR, NEAREST_EVEN, FLOOR_INDEX])
@pytest.mark.parametrize("limit", [50, 2_000_000])
def test_against_numpy(spark, method, limit):
    rng = np.random.default_rng(1)
    groups = {
        "hot": rng.normal(size=6000),
        "ties": rng.integers(0, 4, 3000).astype(float),
        "one": np.array([2.5]),
        "two": np.array([1.0, 2.0]),
        "tail": np.exp(rng.normal(0, 5, 2000)),
        None: rng.normal(size=500),
    }
    frame = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    df = spark.createDataFrame(frame).repartition(7)
    found = {
        r["g"]: r for r in exact_quantiles(df, ["g"], "v", PROBS, method, limit, 16).collect()
    }
    assert set(found) == set(groups)
    for name, values in groups.items():
        assert found[name]["n"] == len(values)
        for p, got in zip(PROBS, found[name]["q"]):
            assert got == pytest.approx(expected(values, p, method), rel=1e-12), (name, p)


def test_nulls_and_nan_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None)], "g string, v double")
    found = exact_quantiles(df, ["g"], "v", [0.5]).collect()
    assert [(r["g"], r["n"], r["q"]) for r in found] == [("a", 1, [1.0])]


def test_a_group_is_needed(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.range(3), [], "id", [0.5])


def test_only_the_bracket_is_shuffled(spark):
    """Rows below the bracket leave a task as one row per group and probability."""
    df = spark.range(200_000).selectExpr("'g' || (id % 2) AS g", "rand(3) AS v")
    plan = exact_quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
