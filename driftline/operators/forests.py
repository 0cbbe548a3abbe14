"""Cross-validated search over random forests whose trees grow whole, each in one task.

Spark ML grows a forest level by level: every level is a job that moves a histogram for
each node and feature, also for nodes of two rows. Here a task gets the binned rows
of a fold's training part and grows some of its trees to the end (:mod:`driftline.functions.trees`).
Tree i of a forest is the same whatever the number of trees, and a shallow tree is the
upper part of a deep one. So a fold's trees grow once, as many and as deep as the
largest point asks for, and each point reads its own: the first trees, down to its depth.
That gives what growing the trees of each point anew would give.

The binned rows must fit a task (``CELLS``); more rows need Spark's level by level.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.trees import Tree, binned, cut_points, drawn, grow, mix
from driftline.session import materialise, new_shared_path

#: Bytes of rows that a task can hold: a byte for each feature, and four for each class, as votes and nodes need.
CELLS = 1 << 27
#: Trees grown by one task.
UNIT_TREES = 25
#: The model that learns from the rows of all folds.
ALL = -1
#: Numbers in one list of votes.
VOTES = 1 << 17
#: A tree's vote is counted in whole parts, so that sums don't depend on their order; a unit's sum fits 32 bits.
WHOLE = 2.0**26

_VOTES = "model int, part int, tried int, bucket int, labels binary, votes binary"
_HITS = "model int, point int, hits long, rows long"
_SPLIT = "struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
#: A node as Spark ML stores it.
_NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,"
    f"rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:{_SPLIT}>"
)


@dataclass(frozen=True)
class Unit:
    """Work of one task: some trees on the rows of a model; its number is the fold that it doesn't learn from, or ALL."""

    model: int
    tried: int  # features that a node tries
    bucket: int
    first: int
    last: int


@dataclass(frozen=True)
class Forest:
    """What all trees have in common."""

    width: int
    classes: int
    bins: int
    seed: int


class StoredSearch(CrossValidatorModel):
    """A search whose best model lies in the shared folder and is read when it is asked for."""

    def __init__(self, stages: Sequence, path: str, means: list[float], deviations: list[float]) -> None:
        self._stages, self._path, self._best = list(stages), path, None
        super().__init__(None, means, None, deviations)

    @property
    def bestModel(self) -> PipelineModel:  # noqa: N802
        if self._best is None:
            read = RandomForestClassificationModel.load
            self._best = PipelineModel([read(self._path) if isinstance(s, RandomForestClassifier) else s for s in self._stages])
        return self._best

    @bestModel.setter
    def bestModel(self, model: PipelineModel | None) -> None:  # noqa: N802
        self._best = model


def _tried(trees: int, width: int) -> int:
    """Features a node tries, as ``featureSubsetStrategy`` "auto" has it."""
    return width if trees == 1 else ceil(sqrt(width))


def _units(model: int, trees: Sequence[int], width: int) -> list[Unit]:
    """The trees of the largest forest; a bucket ends where a smaller one does."""
    ends = defaultdict(set)
    for count in trees:
        ends[_tried(count, width)].add(count)
    units = []
    for tried, counts in sorted(ends.items()):
        start = 0
        for bucket, end in enumerate(sorted(counts)):
            units += [
                Unit(model, tried, bucket, first, min(first + UNIT_TREES, end)) for first in range(start, end, UNIT_TREES)
            ]
            start = end
    return units


# --- rows -----------------------------------------------------------------------


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Folds, and the values as a matrix."""
    values = batch.column("values")
    matrix = values.flatten().to_numpy(zero_copy_only=False)
    if values.null_count or (np.diff(values.offsets.to_numpy()) != width).any() or not np.isfinite(matrix).all():
        raise ValueError(f"features must be {width} numbers, without null, NaN and infinite ones")
    return batch.column("fold").to_numpy(), matrix.reshape(-1, width)


def _cuts(rows: DataFrame, forest: Forest, models: Sequence[int]) -> dict[int, list[np.ndarray]]:
    """Cut points of each feature for each model, from the rows that it learns from."""
    width, bins = forest.width, forest.bins

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                folds, matrix = _read(batch, width)
                yield pa.record_batch(
                    {
                        "feature": pa.array(range(width), pa.int32()),
                        "folds": pa.array([folds.tobytes()] * width, pa.binary()),
                        "values": pa.array([np.ascontiguousarray(x).tobytes() for x in matrix.T], pa.binary()),
                    }
                )

    def cut(table: pa.Table) -> pa.Table:
        folds = np.frombuffer(b"".join(table["folds"].to_pylist()), np.int32)
        values = np.frombuffer(b"".join(table["values"].to_pylist()), np.float64)
        learned = [values[folds != model] for model in models]
        return pa.table(
            {
                "feature": pa.array([table["feature"][0].as_py()] * len(models), pa.int32()),
                "model": pa.array(models, pa.int32()),
                "cuts": pa.array([cut_points(x, min(bins, len(x))) for x in learned], pa.list_(pa.float64())),
            }
        )

    chunks = rows.select("fold", "values").mapInArrow(columns, "feature int, folds binary, values binary")
    found = chunks.groupBy("feature").applyInArrow(cut, "feature int, model int, cuts array<double>").collect()
    points = {(r["model"], r["feature"]): np.array(r["cuts"], np.float64) for r in found}
    return {model: [points[model, feature] for feature in range(width)] for model in models}


def _packed(rows: DataFrame, cuts: dict[int, list[np.ndarray]], width: int) -> DataFrame:
    """All rows in chunks, written once; ``bins_<model>`` has the bins by the cut points of a model."""
    names = ["folds", "ids", "labels", *(f"bins_{model}" for model in cuts)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                folds, matrix = _read(batch, width)
                ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
                packed = [folds.tobytes(), ids.tobytes(), labels.astype(np.int32).tobytes()]
                packed += [binned(matrix, points).tobytes() for points in cuts.values()]
                yield pa.record_batch([pa.array([x], pa.binary()) for x in packed], names)

    return materialise(rows.mapInArrow(work, ", ".join(f"`{name}` binary" for name in names)), "grid-bins")


def _dealt(packed: DataFrame, units: list[Unit]) -> DataFrame:
    """The rows of each unit, each unit a partition of its own, which reads what is written and moves nothing."""

    def rows(number: int) -> DataFrame:
        bins = F.col(f"`bins_{units[number].model}`").alias("bins")
        return packed.select(F.lit(number).alias("unit"), "folds", "ids", "labels", bins)

    # A union of nothing but single partitions is one partition since Spark 4.1: this part without rows is dealt otherwise.
    none = rows(0).filter(F.length("ids") < 0)
    return reduce(DataFrame.unionAll, [none, *(rows(i).coalesce(1) for i in range(len(units)))])


def _gathered(chunks: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folds, ids, labels, bins) of a unit's rows in the order of ids; equal rows of a fold get different ids."""

    def joined(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(x[name] for x in chunks), kind)

    ids = joined("ids", np.int64).view(np.uint64)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    copy = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)]))
    bins = joined("bins", np.uint8).reshape(-1, width)[order]
    return joined("folds", np.int32)[order], mix(ids + mix(copy)), joined("labels", np.int32)[order], bins


def _grown(
    dealt: DataFrame,
    units: list[Unit],
    forest: Forest,
    depth: int,
    then: Callable[[Unit, np.ndarray, np.ndarray, Iterator[tuple[int, Tree]]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """What ``then(unit, labels and bins of the rows not learned from, trees)`` makes of every unit."""
    width, classes, seed = forest.width, forest.classes, forest.seed

    def trees(unit: Unit, ids: np.ndarray, labels: np.ndarray, bins: np.ndarray) -> Iterator[tuple[int, Tree]]:
        for number in range(unit.first, unit.last):
            weight = drawn(ids, seed, number)
            yield number, grow(bins, labels, weight, classes, depth, unit.tried, seed, number)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = defaultdict(list)
        for batch in batches:
            for chunk in batch.to_pylist():
                chunks[chunk["unit"]].append(chunk)
        for number in sorted(chunks):
            unit = units[number]
            folds, ids, labels, bins = _gathered(chunks.pop(number), width)
            learned = folds != unit.model
            own = trees(unit, ids[learned], labels[learned], bins[learned])
            yield from then(unit, labels[~learned], bins[~learned], own)

    return dealt.mapInArrow(work, schema)


# --- scores -----------------------------------------------------------------------


def _hits(votes: DataFrame, points: Sequence[tuple[int, int]], forest: Forest) -> DataFrame:
    """Held-out rows and right answers of each model and point."""
    classes, width = forest.classes, forest.width
    depths = sorted({depth for _, depth in points})
    counts = sorted({trees for trees, _ in points})
    last = {}  # a number of trees -> the bucket that ends with it
    for unit in _units(0, counts, width):
        last[unit.tried, unit.last] = unit.bucket

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        labels = np.frombuffer(rows[0]["labels"], np.int32)
        sums = defaultdict(lambda: np.zeros((len(depths), len(labels), classes), np.int64))
        for row in rows:
            sums[row["tried"], row["bucket"]] += np.frombuffer(row["votes"], np.int32).reshape(len(depths), -1, classes)
        hits = []
        for trees, depth in points:
            tried = _tried(trees, width)
            whole = sum(sums[tried, bucket][depths.index(depth)] for bucket in range(last[tried, trees] + 1))
            hits.append(int((whole.argmax(1) == labels).sum()))
        size = len(points)
        return pa.table(
            {
                "model": pa.array([rows[0]["model"]] * size, pa.int32()),
                "point": pa.array(range(size), pa.int32()),
                "hits": pa.array(hits, pa.int64()),
                "rows": pa.array([len(labels)] * size, pa.int64()),
            }
        )

    return votes.groupBy("model", "part").applyInArrow(count, _HITS)


def _accuracies(packed: DataFrame, points: Sequence[tuple[int, int]], folds: int, forest: Forest) -> np.ndarray:
    """Of each point (trees, depth) and fold."""
    classes, width = forest.classes, forest.width
    depths = sorted({depth for _, depth in points})
    units = [u for model in range(folds) for u in _units(model, sorted({trees for trees, _ in points}), width)]

    def vote(
        unit: Unit, labels: np.ndarray, bins: np.ndarray, trees: Iterator[tuple[int, Tree]]
    ) -> Iterator[pa.RecordBatch]:
        votes = np.zeros((len(depths), len(labels), classes), np.int32)
        for _, tree in trees:
            total = np.maximum(tree.counts.sum(1, keepdims=True), 1)  # few rows may all be left out by chance
            shares = np.rint(tree.counts / total * WHOLE).astype(np.int32)
            for i, depth in enumerate(depths):
                votes[i] += shares[tree.descend(bins, tree.leaves(depth))]
        step = max(1, VOTES // (len(depths) * classes))
        for part, start in enumerate(range(0, len(labels), step)):
            some = slice(start, start + step)
            values = [unit.model, part, unit.tried, unit.bucket]
            packed = [labels[some].tobytes(), votes[:, some].tobytes()]
            yield pa.record_batch(
                [*(pa.array([x], pa.int32()) for x in values), *(pa.array([x], pa.binary()) for x in packed)],
                ["model", "part", "tried", "bucket", "labels", "votes"],
            )

    votes = _grown(_dealt(packed, units), units, forest, depths[-1], vote, _VOTES)
    counted = _hits(votes, points, forest).groupBy("model", "point").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))
    out = np.zeros((len(points), folds))
    for r in counted.collect():
        out[r["point"], r["model"]] = r["hits"] / r["rows"]
    return out


# --- the best forest --------------------------------------------------------------


def _nodes(number: int, tree: Tree, depth: int, cuts: list[np.ndarray]) -> pa.RecordBatch:
    """The nodes of a tree in the form that Spark ML stores; parents come before their children."""
    leaf = tree.leaves(depth)
    kept = np.zeros(len(leaf), bool)
    kept[0] = True
    for level in range(int(tree.depth[-1])):
        at = np.arange(*np.searchsorted(tree.depth, [level, level + 1]))
        inner = tree.left[at[kept[at] & ~leaf[at]]]
        kept[inner] = kept[inner + 1] = True
    place, at = np.cumsum(kept) - 1, np.flatnonzero(kept)
    inside = ~leaf[at]
    left = np.where(inside, place[tree.left[at]], -1)
    counts = tree.counts[at].astype(np.float64)
    total = counts.sum(1)
    thresholds = [cuts[f][b] for f, b in zip(tree.feature[at[inside]], tree.bin[at[inside]])]
    lists = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(inside)], pa.int32()), pa.array(thresholds, pa.float64())
    )
    split = {
        "featureIndex": pa.array(np.where(inside, tree.feature[at], -1), pa.int32()),
        "leftCategoriesOrThreshold": lists,
        "numCategories": pa.array(np.full(len(at), -1), pa.int32()),
    }
    stats = pa.ListArray.from_arrays(
        pa.array(np.arange(0, counts.size + 1, counts.shape[1]), pa.int32()), pa.array(counts.ravel())
    )
    node = {
        "id": pa.array(np.arange(len(at)), pa.int32()),
        "prediction": pa.array(counts.argmax(1).astype(np.float64)),
        "impurity": pa.array(1.0 - (counts**2).sum(1) / np.maximum(total, 1.0) ** 2),
        "impurityStats": stats,
        "rawCount": pa.array(total.astype(np.int64)),
        "gain": pa.array(np.where(inside, tree.gain[at], -1.0)),
        "leftChild": pa.array(left, pa.int32()),
        "rightChild": pa.array(np.where(inside, left + 1, -1), pa.int32()),
        "split": pa.StructArray.from_arrays(list(split.values()), list(split)),
    }
    return pa.record_batch(
        [pa.array(np.full(len(at), number), pa.int32()), pa.StructArray.from_arrays(list(node.values()), list(node))],
        ["treeID", "nodeData"],
    )


def _described(kind: str, uid: str, params: dict[str, dict], spark, **more: int) -> str:
    head = {"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid}
    return json.dumps(head | params | more)


def _stored(
    packed: DataFrame, estimator: RandomForestClassifier, cuts: list[np.ndarray], forest: Forest, model: int = ALL
) -> str:
    """Path of a model's forest, which Spark ML can load."""
    spark, classes = packed.sparkSession, forest.classes
    trees, depth = estimator.getNumTrees(), estimator.getMaxDepth()
    units = _units(model, [trees], forest.width)

    def nodes(unit: Unit, labels: np.ndarray, bins: np.ndarray, own: Iterator[tuple[int, Tree]]) -> Iterator[pa.RecordBatch]:
        for number, tree in own:
            yield _nodes(number, tree, depth, cuts)

    path = new_shared_path(spark, "grid-best")
    _grown(_dealt(packed, units), units, forest, depth, nodes, _NODES).write.parquet(f"{path}/data")

    def params(names: set[str]) -> dict[str, dict]:
        known = [p for p in estimator.params if p.name in names and estimator.hasDefault(p)]
        chosen = [p for p in estimator.params if p.name in names and estimator.isSet(p)]
        plain = RandomForestClassifier()
        return {
            "paramMap": {p.name: estimator.getOrDefault(p) for p in chosen},
            "defaultParamMap": {p.name: plain.getOrDefault(plain.getParam(p.name)) for p in known},
        }

    own = params({p.name for p in estimator.params})
    of_trees = params({p.name for p in DecisionTreeClassifier().params})
    size = {"numFeatures": forest.width, "numClasses": classes}
    whole = _described("RandomForestClassificationModel", estimator.uid, own, spark, **size, numTrees=trees)
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = [(i, _described("DecisionTreeClassificationModel", f"{estimator.uid}_{i}", of_trees, spark, **size), 1.0) for i in range(trees)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return path


# --- the search -------------------------------------------------------------------


def _ordered_numbers(vector: DataFrame, name: str) -> bool:
    """Whether no feature is marked as a category."""
    kinds = vector.schema[name].metadata.get("ml_attr", {}).get("attrs", {})
    return not {"nominal", "binary"} & set(kinds)


def search(
    validator: CrossValidator, rows: DataFrame, key: str, classes: int, cells: int = CELLS
) -> CrossValidatorModel | None:
    """What ``validator.fit(rows)`` does, for a pipeline around a random forest; None where that has to do it.

    ``rows`` have ``_label`` and ``_fold``. The trees draw other rows and features than Spark's.
    """
    stages = validator.getEstimator().getStages()
    estimator = next(s for s in stages if isinstance(s, RandomForestClassifier))
    grid = [{p.name: v for p, v in point.items()} for point in validator.getEstimatorParamMaps()]
    if not all(set(point) <= {"numTrees", "maxDepth"} for point in grid):
        return None
    points = [
        (int(p.get("numTrees", estimator.getNumTrees())), int(p.get("maxDepth", estimator.getMaxDepth()))) for p in grid
    ]
    folds = validator.getNumFolds()
    sizes = {r["_fold"]: r["count"] for r in rows.groupBy("_fold").count().collect()}
    for fold in range(folds):
        if sum(sizes.values()) == sizes.get(fold, 0):
            raise ValueError(f"The training data at fold {fold} is empty.")
        if not sizes.get(fold):
            raise ValueError(f"The validation data at fold {fold} is empty.")
    assembled = rows
    for stage in stages[: stages.index(estimator)]:
        assembled = stage.transform(assembled)
    vector = estimator.getFeaturesCol()
    values = vector_to_array(F.col(vector))
    width = assembled.select(F.size(values)).first()[0] or 0
    held = sum(sizes.values()) * (width + 4 * classes)
    if width < 1 or held > cells or estimator.getMaxBins() > 256 or not _ordered_numbers(assembled, vector):
        return None
    forest = Forest(width, classes, estimator.getMaxBins(), estimator.getSeed())
    hashed = assembled.select(
        F.col("_fold").alias("fold"), F.col("_label").cast("int").alias("label"), F.col(key).alias("_key"), values.alias("values")
    ).select(F.xxhash64("fold", "_key", "label", "values").alias("id"), "fold", "label", "values")
    cuts = _cuts(hashed, forest, [*range(folds), ALL])
    packed = _packed(hashed, cuts, width)
    accuracy = _accuracies(packed, points, folds, forest)
    means = [float(x) for x in accuracy.mean(1)]
    best = points[int(np.argmax(means))]
    fitted = estimator.copy({estimator.numTrees: best[0], estimator.maxDepth: best[1]})
    path = _stored(packed, fitted, cuts[ALL], forest)
    model = StoredSearch(stages, path, means, [float(x) for x in accuracy.std(1)])
    for param in validator.params:
        if validator.isSet(param) and model.hasParam(param.name):
            model.set(model.getParam(param.name), validator.getOrDefault(param))
    return model
