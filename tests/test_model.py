import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.errors import MissingColumnError, TrainingError
from driftline.operators import features, model

NUMBERS = ["sepal_length", "sepal_width", "petal_length", "petal_width"]


@pytest.fixture(scope="module")
def split(spark, flowers):
    df = spark.createDataFrame(flowers)
    return model.use_upstream_split(df, "species", "id")


@pytest.fixture(scope="module")
def fitted(split):
    return model.train_forest(split[0], NUMBERS, "species", trees=10, depth=4)


def test_split_is_honoured(spark, flowers):
    df = spark.createDataFrame(flowers).withColumn("is_train", (F.col("id") < 10).cast("int"))
    train, held_out = model.use_upstream_split(df, "species", "id")
    assert train.count() == 10 and held_out.count() == 140 and "is_train" not in train.columns
    with pytest.raises(MissingColumnError):
        model.use_upstream_split(df, "nope", "id")


def test_forest_learns(split, fitted):
    scored = model.batch_score(split[1], fitted)
    row = model.evaluate(scored, "species").first()
    assert row["rows"] == 30 and row["accuracy"] >= 0.9 and row["f1_score"] >= 0.9
    assert scored.filter("score < 0 OR score > 1").count() == 0


def test_scores_do_not_depend_on_the_path(split, fitted, tmp_path):
    from pyspark.ml import PipelineModel

    fitted.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    one = {r["id"]: r["prediction"] for r in model.batch_score(split[1], fitted).collect()}
    two = {r["id"]: r["prediction"] for r in model.batch_score(split[1].repartition(5), again).collect()}
    assert one == two


def test_cross_validation(split):
    folds = model.cross_validate(split[0], NUMBERS, "species", "id", folds=3, trees=5, depth=3)
    accuracies = [r["accuracy"] for r in folds.collect()]
    row = model.cross_validation_summary(folds).first()
    assert len(accuracies) == 3
    assert row["cv_mean"] == pytest.approx(np.mean(accuracies)) and row["cv_std"] == pytest.approx(np.std(accuracies))


def test_evaluate_by_hand(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    row = model.evaluate(df, "label").first()
    f1 = {"a": 2 * 3 / (4 + 4), "b": 2 * 2 / (2 + 3), "c": 0.0}
    assert row["accuracy"] == pytest.approx(5 / 7)
    assert row["f1_score"] == pytest.approx((4 * f1["a"] + 2 * f1["b"]) / 7)


def test_permutation_importance_finds_the_signal(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(300).select(
        "id", F.rand(1).alias("noise"), (F.col("id") % 2).cast("double").alias("signal"), (F.col("id") % 2).alias("y")
    ).withColumn("v", array_to_vector(F.array("noise", "signal")))
    fitted = model.train_forest(df, "v", "y", trees=5, depth=3)
    lost = {r["position"]: r["importance"] for r in model.permutation_importance(fitted, df, "v", "y", "id", 2).collect()}
    assert lost[1] > 0.2 and abs(lost[0]) < 0.05
    with pytest.raises(TrainingError):
        model.permutation_importance(fitted, df.limit(0), "v", "y", "id", 2)


def gate(spark, data, threshold=0.8, kind="double"):
    df = spark.createDataFrame(data, f"y {kind}, prediction {kind}, is_train int")
    return model.model_gate(df, "y", threshold)


def test_gate(spark):
    good = [(0.0, 0.0, 0), (1.0, 1.0, 0), (1.0, 0.0, 1)]
    row = gate(spark, good).first()
    assert row["passed"] and row["accuracy"] == 1.0 and row["rows"] == 2
    model.require_gate(gate(spark, good))
    one_class = gate(spark, [(0.0, 0.0, 0), (0.0, 0.0, 0)]).first()
    assert not one_class["passed"] and not one_class["checks"]["class_diversity"]
    broken = gate(spark, [(0.0, 0.0, 0), (1.0, float("nan"), 0), (1.0, float("inf"), 0)]).first()
    assert broken["prediction_failures"] == 2 and not broken["passed"]
    with pytest.raises(TrainingError, match="no held-out rows"):
        model.require_gate(gate(spark, [(0.0, 0.0, 1)]))


def test_outputs(spark):
    df = spark.createDataFrame(
        [("e", "a", 0.5, 0.1, None), ("e", "a", 1.5, 0.2, None), ("e", None, 0.5, 0.3, None), ("e", None, None, 9.0, "x")],
        "endpoint string, label string, score double, latency double, error string",
    )
    row = model.check_outputs(df, ["endpoint"], 0.25).first()
    assert (row["num_successful"], row["num_failed"], row["schema_failures"]) == (3, 1, 2)
    assert row["p95_latency"] == 0.3 and row["avg_latency"] == 0.2 and not row["passed"]


def test_batch_counts(spark):
    asked = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "id string, rows int")
    answered = spark.createDataFrame([("a", 2), ("b", 1)], "id string, rows int")
    found = {r["id"]: r["ok"] for r in model.check_batch_counts(asked, answered, "id").collect()}
    assert found == {"a": True, "b": False, "c": False}


def test_outside_model(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0, 2.0]}))
    assert [r["prediction"] for r in model.predict_with(df, lambda f: f["x"] * 2, ["x"]).collect()] == [2.0, 4.0]
    short = model.predict_with(df, lambda f: [], ["x"]).collect()
    assert len(short) == 2 and all("0 predictions" in r["error"] for r in short)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_one_failing_row_fails_alone(spark, parts):
    def model_of(frame):
        if (frame["x"] == 37).any():
            raise ValueError("no 37")
        return frame["x"] * 2

    df = spark.range(100).select(F.col("id").cast("double").alias("x")).repartition(parts)
    rows = model.predict_with(df, model_of, ["x"]).collect()
    assert [r["x"] for r in rows if r["error"]] == [37.0]
    assert all(r["prediction"] == 2 * r["x"] for r in rows if not r["error"]) and len(rows) == 100


def test_features_feed_the_model(spark, flowers):
    matrix, state = features.build_features(spark.createDataFrame(flowers), "species", "id", keep=["id"])
    train, held_out = model.use_upstream_split(matrix, "species", "id")
    names = [c for c in matrix.columns if c.startswith("scaler__")]
    fitted = model.train_forest(train, names, "species", trees=10, depth=4)
    raw = features.transform(spark.createDataFrame(flowers), state, ["id"])
    served = {r["id"]: r["prediction"] for r in model.batch_score(raw, fitted).collect()}
    for r in model.batch_score(held_out, fitted).collect():
        assert served[r["id"]] == r["prediction"]


def test_registered_grid_search_is_the_whole_one(spark, monkeypatch):
    import inspect

    from driftline.plans import models

    asked = {}
    signature = inspect.signature(model.grid_search)

    def noted(*args, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        asked.update(call.arguments)
        return None, None

    monkeypatch.setattr(models.model, "grid_search", noted)
    models.grid_search(spark, "/root/testdata/sf0.001")
    assert asked["grid"] == {"numTrees": (50, 100, 200), "maxDepth": (5, 10, 20)} and asked["folds"] == 5


def test_grid_search_keeps_the_nodes_of_rows_and_fits_the_same_trees(split, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    # Both searches read one table: forests depend on the order of rows in the files.
    written, write = [], model.materialise

    def once(df, label):
        written.append(write(df, label) if not written else written[0])
        return written[-1]

    monkeypatch.setattr(model, "materialise", once)

    def search():
        grid = {"numTrees": (3, 5), "maxDepth": (2, 8)}
        fitted, points = model.grid_search(split[0], NUMBERS, "species", "id", grid=grid, folds=2)
        forest = next(s for s in fitted.bestModel.stages if hasattr(s, "featureImportances"))
        return forest, sorted(tuple(r) for r in points.collect())

    kept, points = search()
    assert kept.getCacheNodeIds() and len(points) == 4
    monkeypatch.setattr(RandomForestClassifier, "setCacheNodeIds", lambda forest, value: forest)
    plain, plain_points = search()
    assert not plain.getCacheNodeIds()
    assert points == plain_points
    assert kept.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
