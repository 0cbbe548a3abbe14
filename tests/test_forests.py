"""Grid search over trees that grow whole in tasks, against Spark ML's own trees and scores."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from driftline.functions import trees
from driftline.operators import forests, model

NUMBERS = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
GRID = {"numTrees": (3, 5, 30), "maxDepth": (2, 6)}


@pytest.fixture(scope="module")
def flower_rows(spark, flowers):
    return spark.createDataFrame(flowers)


def points_of(rows, grid=GRID, folds=3):
    found = model.grid_search(rows, NUMBERS, "species", "id", grid=grid, folds=folds)[1].collect()
    return {(r["numTrees"], r["maxDepth"]): (r["cv_mean"], r["cv_std"]) for r in found}, {
        (r["numTrees"], r["maxDepth"]) for r in found if r["best"]
    }


def test_no_forest_is_grown_level_by_level(flower_rows, monkeypatch):
    def no_fit(*_):
        raise AssertionError("a job for each level of each forest")

    monkeypatch.setattr(CrossValidator, "fit", no_fit)
    monkeypatch.setattr(RandomForestClassifier, "fit", no_fit)
    scores, best = points_of(flower_rows)
    assert set(scores) == {(t, d) for t in GRID["numTrees"] for d in GRID["maxDepth"]} and len(best) == 1
    assert all(0.8 <= mean <= 1 for mean, _ in scores.values())


def test_a_point_scores_alone_as_in_the_grid(flower_rows):
    scores, _ = points_of(flower_rows)
    for trees_, depth in ((3, 2), (5, 6), (30, 2)):
        alone, best = points_of(flower_rows.repartition(7), {"numTrees": (trees_,), "maxDepth": (depth,)})
        assert alone == {(trees_, depth): scores[trees_, depth]} and best == {(trees_, depth)}


# Deeper trees on few values have splits of equal gain, among which rounding decides in Spark.
@pytest.mark.parametrize(("shape", "depth"), [("many values", 1), ("many values", 3), ("many values", 8), ("few values", 1), ("few values", 3)])
def test_a_tree_of_all_rows_and_features_is_sparks_decision_tree(spark, depth, shape):
    rng = np.random.default_rng(depth)
    n, classes = 400, 4
    matrix = rng.normal(size=(n, 5)) if shape == "many values" else rng.integers(0, 6, (n, 5)).astype(float)
    label = (np.abs(matrix[:, 0] * 2 + matrix[:, 1]).astype(int) + rng.integers(0, 2, n)) % classes
    rows = spark.createDataFrame([(*map(float, x), float(y)) for x, y in zip(matrix, label)], "a double, b double, c double, d double, e double, _label double")
    rows = VectorAssembler(inputCols=list("abcde"), outputCol="v").transform(rows)
    asked = DecisionTreeClassifier(featuresCol="v", labelCol="_label", maxDepth=depth).fit(rows)
    cuts = [trees.cut_points(x, 32) for x in matrix.T]
    grown = trees.grow(trees.binned(matrix, cuts), label, np.ones(n, int), classes, 9, 5, 42, 0)
    small = trees.grow(trees.binned(matrix, cuts), label, np.ones(n, int), classes, 9, 5, 42, 0, pairs=100)
    assert all((getattr(grown, x) == getattr(small, x)).all() for x in ("feature", "bin", "left", "gain", "counts"))
    nodes = forests._nodes(0, grown, depth, cuts).to_pydict()["nodeData"]

    def written(node, indent):
        pad = " " * indent
        if node["leftChild"] < 0:
            return [f"{pad}Predict: {node['prediction']}"]
        feature, at = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        return [
            f"{pad}If (feature {feature} <= {at})",
            *written(nodes[node["leftChild"]], indent + 1),
            f"{pad}Else (feature {feature} > {at})",
            *written(nodes[node["rightChild"]], indent + 1),
        ]

    assert written(nodes[0], 2) == asked.toDebugString.rstrip("\n").split("\n")[1:]


def test_scores_are_those_of_the_stored_forest_in_spark(spark, flower_rows):
    """A fold's forest, stored and read as Spark ML's, answers as the votes counted."""
    indexed, labels = model._indexed(flower_rows, "species")
    marked = model.stratified_folds(indexed, "species", "id", 3)
    vector = VectorAssembler(inputCols=NUMBERS, outputCol="_features").transform(marked)
    rows = vector.select(
        F.xxhash64("id").alias("id"), F.col("_fold").alias("fold"), F.col("_label").cast("int").alias("label"), vector_to_array("_features").alias("values")
    ).cache()
    forest = forests.Forest(4, len(labels), 32, 42)
    points = [(t, d) for t in (1, 3, 30) for d in (2, 5)]
    cuts = forests._cuts(rows, forest, [0, 1, 2])
    packed = forests._packed(rows, cuts, 4)
    accuracy = forests._accuracies(packed, points, 3, forest)
    for i, (count, depth) in enumerate(points):
        asked = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=count, maxDepth=depth, seed=42)
        path = forests._stored(packed, asked, cuts[1], forest, model=1)
        read = RandomForestClassificationModel.load(path)
        assert read.getNumTrees == count and read.numClasses == 3 and len(read.trees) == count
        assert sum(read.featureImportances.toArray()) == pytest.approx(1) and max(t.depth for t in read.trees) <= depth
        right = read.transform(vector.filter("_fold = 1")).filter("prediction = _label").count()
        assert right / vector.filter("_fold = 1").count() == accuracy[i, 1]


def test_forest_is_as_good_as_sparks(flower_rows, monkeypatch):
    scores, _ = points_of(flower_rows)
    monkeypatch.setattr(forests, "search", lambda *_: None)
    sparks, _ = points_of(flower_rows)
    assert scores.keys() == sparks.keys()
    assert all(abs(scores[p][0] - sparks[p][0]) <= 0.06 for p in scores)


def test_rows_beyond_a_task_and_other_parameters_are_left_to_spark(flower_rows, monkeypatch):
    asked, fit = [], CrossValidator.fit
    monkeypatch.setattr(CrossValidator, "fit", lambda self, *a: asked.append(1) or fit(self, *a))
    grid = {"numTrees": (2,), "maxDepth": (2,)}
    points_of(flower_rows, grid)
    assert not asked
    model.grid_search(flower_rows, NUMBERS, "species", "id", grid={"numTrees": (2,), "minInstancesPerNode": (1, 9)}, folds=2)
    assert len(asked) == 1
    cells, search = 150 * (4 + 4 * 3), forests.search
    monkeypatch.setattr(forests, "search", lambda *a: search(*a, cells=cells))
    points_of(flower_rows, grid)
    assert len(asked) == 1
    cells -= 1
    points_of(flower_rows, grid)
    assert len(asked) == 2


def test_rows_that_come_twice_are_drawn_each_for_itself(flower_rows):
    twice = flower_rows.unionAll(flower_rows)
    scores, _ = points_of(twice)
    assert scores == points_of(twice.repartition(5))[0]
    keyless, _ = points_of(twice.withColumn("id", F.when(F.col("id") % 3 > 0, F.col("id"))))
    assert all(0.8 <= mean <= 1 for mean, _ in keyless.values())
    chunk = {"ids": np.array([7, 5, 7, 7]).tobytes(), "folds": np.zeros(4, np.int32).tobytes()}
    chunk |= {"labels": np.arange(4, dtype=np.int32).tobytes(), "bins": bytes(4)}
    assert len(set(forests._gathered([chunk], 1)[1].tolist())) == 4
    weights = trees.drawn(np.arange(100_000, dtype=np.uint64), 42, 3)
    share = np.bincount(weights)[:4] / len(weights)
    assert share == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=0.005)


@pytest.mark.parametrize("wrong", [float("nan"), float("inf"), None])
def test_values_that_are_no_numbers_end_the_search(spark, wrong):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(40).select("id", (F.col("id") % 2).alias("y"), F.when(F.col("id") != 9, F.col("id").cast("double")).otherwise(F.lit(wrong)).alias("x"))
    vector = array_to_vector(F.array("x")) if wrong is not None else F.when(F.col("x").isNotNull(), array_to_vector(F.array(F.coalesce("x", F.lit(0.0)))))
    with pytest.raises(Exception, match="null|NaN|infinite"):
        model.grid_search(rows.withColumn("v", vector), "v", "y", "id", grid={"numTrees": (2,), "maxDepth": (2,)}, folds=2)


def test_folds_without_rows_are_refused(flower_rows):
    with pytest.raises(ValueError, match="validation data at fold 2 is empty"):
        model.grid_search(flower_rows.limit(2), NUMBERS, "species", "id", grid=GRID, folds=5)


def test_a_search_is_kept_and_read_like_any_other(flower_rows, tmp_path):
    from pyspark.ml.tuning import CrossValidatorModel

    found, points = model.grid_search(flower_rows, NUMBERS, "species", "id", grid={"numTrees": (3, 5), "maxDepth": (3,)}, folds=2)
    best = points.filter("best").first()
    assert found.avgMetrics[found.avgMetrics.index(max(found.avgMetrics))] == best["cv_mean"] and found.getNumFolds() == 2
    forest = next(s for s in found.bestModel.stages if hasattr(s, "featureImportances"))
    assert forest.getNumTrees == best["numTrees"] == len(forest.trees) and forest.getMaxDepth() == 3
    found.write().save(str(tmp_path / "m"))
    again = CrossValidatorModel.load(str(tmp_path / "m"))
    scored = model.batch_score(flower_rows, found.bestModel)
    assert again.avgMetrics == found.avgMetrics and again.getNumFolds() == 2
    assert sorted(map(str, again.transform(flower_rows).select("id", "prediction").collect())) == sorted(
        map(str, scored.select("id", "prediction").collect())
    )
    assert model.evaluate(scored, "species").first()["accuracy"] > 0.9
