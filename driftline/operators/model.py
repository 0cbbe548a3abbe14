"""Training, scoring and gating of classifiers with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import MissingColumnError, TrainingError
from driftline.functions.order_stats import FLOOR_INDEX, exact_quantiles
from driftline.functions.scalars import join_on_keys, ratio, stable_hash
from driftline.operators import forests
from driftline.operators.features import SEED, SPLIT_COLUMN, TEST_SIZE, stratified_split
from driftline.session import materialise

# Forest, folds and grid of the training step.
TREES, DEPTH, FOLDS = 100, 10, 5
GRID = {"numTrees": (50, 100, 200), "maxDepth": (5, 10, 20)}

# Fixed value: message of a failed gate.
GATE_FAILED = "Model did not pass validation gate"


# --- split and folds ----------------------------------------------------------


def use_upstream_split(
    df: DataFrame, target: str, key: str, test_size: float = TEST_SIZE, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, held out): the table's ``is_train`` if there is one, else a stratified split."""
    if target not in df.columns:
        raise MissingColumnError(f"target column {target} not found")
    marked = df if SPLIT_COLUMN in df.columns else stratified_split(df, target, key, test_size, seed)
    return (
        marked.filter(F.col(SPLIT_COLUMN) == 1).drop(SPLIT_COLUMN),
        marked.filter(F.col(SPLIT_COLUMN) == 0).drop(SPLIT_COLUMN),
    )


FOLD_ROWS = 200_000  # rows ranked by one task


def stratified_folds(
    df: DataFrame, target: str, key: str, folds: int = FOLDS, seed: int = SEED, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Adds ``_fold``: the rows of a class, in hash order, go to the folds in turn.

    A class has at most one row more in a fold than in another. Ranges of the
    hash are ranked each for itself and begin where the ranges before them end,
    so that a class with most of the rows is many tasks.
    """
    hashed = df.withColumn("_h", stable_hash(F.col(key), seed))
    ranges = max(1, math.ceil(hashed.count() / fold_rows))
    hashed = hashed.withColumn("_r", F.floor(F.col("_h") / 2.0**60 * ranges))
    sizes = hashed.groupBy(target, "_r").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(target).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(target, "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(target, "_r").orderBy("_h")
    ranked = hashed.withColumn("_row", F.row_number().over(inside) - 1)
    placed = join_on_keys(ranked, starts, [target, "_r"])
    fold = F.pmod(F.col("_row") + F.col("_before"), F.lit(folds)).cast("int")
    return placed.withColumn("_fold", fold).drop("_h", "_r", "_row", "_before")


# --- forest -------------------------------------------------------------------


def forest_pipeline(
    features: Sequence[str] | str,
    target: str,
    labels: Sequence[str],
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
) -> Pipeline:
    """Assemble, index, random forest, labels back as text.

    ``features`` is a list of number columns or the name of a vector column.
    ``labels`` are the known classes; naming them saves a pass over the data.
    """
    stages = []
    vector = features
    if not isinstance(features, str):
        vector = "_features"
        stages.append(
            VectorAssembler(inputCols=list(features), outputCol=vector, handleInvalid="error")
        )
    stages += [
        RandomForestClassifier(
            featuresCol=vector,
            labelCol="_label",
            predictionCol="_prediction",
            probabilityCol="probability",
            numTrees=trees,
            maxDepth=depth,
            seed=seed,
        ),
        IndexToString(inputCol="_prediction", outputCol="prediction", labels=list(labels)),
    ]
    return Pipeline(stages=stages)


def _indexed(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    text = df.withColumn("_target", F.col(target).cast("string"))
    indexer = StringIndexer(
        inputCol="_target", outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(text)
    return indexer.transform(text), list(indexer.labels)


def train_forest(
    train: DataFrame,
    features: Sequence[str] | str,
    target: str,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
) -> PipelineModel:
    indexed, labels = _indexed(train, target)
    return forest_pipeline(features, target, labels, trees, depth, seed).fit(indexed)


def batch_score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``prediction`` (the class) and ``score`` (its probability)."""
    scored = model.transform(df)
    return scored.withColumn("score", F.array_max(vector_to_array("probability"))).drop(
        "_features", "rawPrediction", "probability", "_prediction"
    )


def cross_validate(
    train: DataFrame,
    features: Sequence[str] | str,
    target: str,
    key: str,
    folds: int = FOLDS,
    **forest: int,
) -> DataFrame:
    """``(fold, accuracy)`` on train rows only; one model per fold, none with fewer rows than folds."""
    # Written once: every fit reads it several times.
    marked = materialise(stratified_folds(train, target, key, folds), "folds")
    if marked.count() < folds:
        return train.sparkSession.createDataFrame([], "fold int, accuracy double")
    parts = []
    for fold in range(folds):  # as many fits as folds, each one distributed
        model = train_forest(marked.filter(F.col("_fold") != fold), features, target, **forest)
        scored = batch_score(marked.filter(F.col("_fold") == fold), model)
        hit = F.col("prediction") == F.col(target).cast("string")
        parts.append(scored.agg(F.lit(fold).alias("fold"), F.avg(hit.cast("double")).alias("accuracy")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold accuracies."""
    return folds.agg(
        F.avg("accuracy").alias("cv_mean"),
        F.stddev_pop("accuracy").alias("cv_std"),
        F.count("accuracy").alias("folds"),
    )


def grid_search(
    train: DataFrame,
    features: Sequence[str] | str,
    target: str,
    key: str,
    grid: dict[str, Sequence[int]] = GRID,
    folds: int = FOLDS,
    seed: int = SEED,
    parallelism: int = 4,
) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated accuracy of every grid point; the best one is fitted on all train rows."""
    indexed, labels = _indexed(train, target)
    # Written once: every fit reads it several times.
    indexed = materialise(stratified_folds(indexed, target, key, folds), "grid-folds")
    pipeline = forest_pipeline(features, target, labels, seed=seed)
    forest = next(s for s in pipeline.getStages() if isinstance(s, RandomForestClassifier))
    # The same trees: a row keeps its node of every tree, instead of going down from the root at each level.
    forest.setCacheNodeIds(True)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    points = builder.build()
    evaluator = MulticlassClassificationEvaluator(
        labelCol="_label", predictionCol="_prediction", metricName="accuracy"
    )
    validator = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=points,
        evaluator=evaluator,
        numFolds=folds,
        foldCol="_fold",
        parallelism=parallelism,
    )
    # Trees of which a task can hold the rows grow whole; Spark ML's level by level only beyond that.
    fitted = forests.search(validator, indexed, key, len(labels)) or validator.fit(indexed)
    best = max(range(len(points)), key=lambda i: fitted.avgMetrics[i])
    rows = [
        (
            *[int(point[forest.getParam(n)]) for n in grid],
            float(fitted.avgMetrics[i]),
            float(fitted.stdMetrics[i]),
            i == best,
        )
        for i, point in enumerate(points)
    ]
    schema = ", ".join(f"{n} int" for n in grid) + ", cv_mean double, cv_std double, best boolean"
    return fitted, train.sparkSession.createDataFrame(rows, schema)


# --- evaluation ---------------------------------------------------------------


def confusion(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(target).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def evaluate(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1, from the confusion counts."""
    cells = confusion(scored, target, prediction)
    # classes squared rows; each cell counts for its label and for its prediction.
    sides = F.array(
        F.struct(
            F.col("label").cast("string").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
        ),
        F.struct(
            F.col("prediction").cast("string").alias("class"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    same = F.col("label") == F.col("prediction")
    per_class = (
        cells.select(F.when(same, F.col("n")).otherwise(0).alias("hit"), F.posexplode(sides))
        .select(F.when(F.col("pos") == 0, F.col("hit")).otherwise(0).alias("hit"), "col.*")
        .groupBy("class")
        .agg(F.sum("hit").alias("hit"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    f1 = F.coalesce(
        ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")), F.lit(0.0)
    )
    return per_class.agg(
        F.sum("support").alias("rows"),
        ratio(F.sum("hit"), F.sum("support")).alias("accuracy"),
        ratio(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_score"),
    )


def forest_importance(model: PipelineModel, spark, names: Sequence[str]) -> DataFrame:
    """Impurity importance per feature."""
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    values = forest.featureImportances.toArray()
    return spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double"
    )


def permutation_importance(
    model: PipelineModel,
    held_out: DataFrame,
    vector: str,
    target: str,
    key: str,
    width: int,
    rows: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``(position, importance)``: accuracy lost when one feature comes from another row.

    Uses all held-out rows, or ``rows`` of them, the first in hash order. The donor
    of a row is the next one of its hash bucket; buckets hold about 1000 rows.
    """
    hashed = held_out.withColumn("_h", stable_hash(F.col(key), seed))
    if rows is not None:
        hashed = hashed.orderBy("_h").limit(rows)
    count = hashed.count()
    if count == 0:
        raise TrainingError("no held-out rows to measure importance on")
    bucket = W.partitionBy("_b")
    order = bucket.orderBy("_h")
    paired = (
        hashed.select(
            F.col(target).cast("string").alias("_truth"),
            F.col(vector).alias("_own"),
            "_h",
            F.pmod("_h", F.lit(max(1, count // 1000))).alias("_b"),
        )
        .withColumn("_donor", F.coalesce(F.lead("_own").over(order), F.first("_own").over(order)))
        .withColumn("position", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))))
    )
    own, donor = vector_to_array("_own"), vector_to_array("_donor")
    swapped = F.transform(
        F.arrays_zip(own.alias("a"), donor.alias("b")),
        lambda pair, i: F.when(i == F.col("position"), pair["b"]).otherwise(pair["a"]),
    )
    scored = batch_score(
        paired.select("_truth", "position", array_to_vector(swapped).alias(vector)), model
    )
    accuracy = (
        scored.groupBy("position")
        .agg(F.avg((F.col("prediction") == F.col("_truth")).cast("double")).alias("accuracy"))
    )
    whole = F.max(F.when(F.col("position") == -1, F.col("accuracy"))).over(W.partitionBy(F.lit(0)))
    return (
        accuracy.withColumn("_whole", whole)  # one row per feature
        .filter(F.col("position") >= 0)
        .select("position", (F.col("_whole") - F.col("accuracy")).alias("importance"))
    )


# --- gates --------------------------------------------------------------------


def model_gate(
    scored: DataFrame,
    target: str,
    threshold: float,
    prediction: str = "prediction",
    min_classes: int = 2,
) -> DataFrame:
    """One row: the checks of a model on held-out rows, and whether it passed.

    Missing, NaN and infinite predictions are failures. Without held-out rows
    the gate does not pass and says so.
    """
    held_out = scored.filter(F.col(SPLIT_COLUMN) == 0) if SPLIT_COLUMN in scored.columns else scored
    value = F.col(prediction)
    broken = value.isNull()
    if isinstance(scored.schema[prediction].dataType, (T.DoubleType, T.FloatType)):
        broken = broken | F.isnan(prediction) | (F.abs(value) == float("inf"))
    right = F.coalesce(value == F.col(target), F.lit(False)).cast("double")
    counted = held_out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(broken).alias("prediction_failures"),
        F.count_distinct(prediction).alias("classes_predicted"),
        F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"),
    )
    checks = {
        "accuracy_threshold": F.col("accuracy") >= threshold,
        "class_diversity": F.col("classes_predicted") >= min_classes,
        "predictions_ok": F.col("prediction_failures") == 0,
    }
    passed = F.col("rows") > 0
    for check in checks.values():
        passed = passed & check
    return counted.select(
        "*",
        F.lit(float(threshold)).alias("threshold"),
        F.create_map(*[c for n, v in checks.items() for c in (F.lit(n), v)]).alias("checks"),
        passed.alias("passed"),
        F.when(F.col("rows") == 0, "no held-out rows")
        .when(~passed, GATE_FAILED)
        .alias("error_message"),
    )


def require_gate(gate: DataFrame) -> None:
    """Raises unless the gate passed."""
    row = gate.first()
    if not row["passed"]:
        raise TrainingError(f"{row['error_message']}: {row['checks']}")


def check_outputs(
    outputs: DataFrame,
    keys: Sequence[str],
    latency_limit: float,
    label: str = "label",
    score: str = "score",
    latency: str = "latency",
    error: str = "error",
) -> DataFrame:
    """Per group: scored and failed rows, schema check, mean and P95 latency, verdict.

    A scored row needs a label and a score in [0, 1]. Latencies of failed rows
    do not count; the P95 is the item at index floor(0.95*n).
    """
    failed = F.col(error).isNotNull()
    value = F.col(score)
    wrong = ~failed & (
        F.col(label).isNull()
        | value.isNull()
        | F.isnan(value.cast("double"))
        | (value < 0)
        | (value > 1)
    )
    counted = outputs.groupBy(*keys).agg(
        F.count_if(~failed).alias("num_successful"),
        F.count_if(failed).alias("num_failed"),
        F.count_if(wrong).alias("schema_failures"),
        F.coalesce(F.avg(F.when(~failed, F.col(latency))), F.lit(0.0)).alias("avg_latency"),
    )
    p95 = exact_quantiles(outputs.filter(~failed), keys, latency, [0.95], FLOOR_INDEX)
    joined = join_on_keys(counted, p95.select(*keys, F.col("q")[0].alias("p95")), keys, "left")
    late = F.coalesce("p95", F.lit(0.0))
    checks = {
        "all_inferences_passed": F.col("num_failed") == 0,
        "output_schema_valid": F.col("schema_failures") == 0,
        "latency_within_threshold": late <= latency_limit,
    }
    passed = F.lit(True)
    for check in checks.values():
        passed = passed & check
    return joined.select(
        *keys,
        "num_successful",
        "num_failed",
        "schema_failures",
        F.round("avg_latency", 4).alias("avg_latency"),
        F.round(late, 4).alias("p95_latency"),
        *[c.alias(n) for n, c in checks.items()],
        passed.alias("passed"),
    )


def check_batch_counts(
    requests: DataFrame, responses: DataFrame, key: str, rows: str = "rows"
) -> DataFrame:
    """Per request: rows asked and answered; ok if equal and not empty."""
    joined = requests.select(key, F.col(rows).alias("asked")).join(
        responses.select(key, F.col(rows).alias("answered")), key, "left"
    )
    answered = F.coalesce("answered", F.lit(0))
    return joined.select(
        key,
        "asked",
        answered.alias("answered"),
        ((answered > 0) & (answered == F.col("asked"))).alias("ok"),
    )


def prediction_distribution(scored: DataFrame, prediction: str, window: Column) -> DataFrame:
    """Share of every predicted class per time window."""
    counts = scored.groupBy(window.alias("ts"), F.col(prediction).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(W.partitionBy("ts"))  # one row per class
    return counts.withColumn("share", F.col("n") / total)


# --- models from outside ------------------------------------------------------


def predict_with(
    df: DataFrame,
    predict: Callable[[pd.DataFrame], Sequence],
    features: Sequence[str],
    result: str = "double",
) -> DataFrame:
    """Scores with a function of a pandas frame, batch by batch in the tasks.

    Adds ``prediction`` and ``error``. A row on which the model raises gets an
    error text; the job goes on. A batch that raises is tried again in halves, so
    that the result does not depend on how rows are dealt to batches.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("prediction", T.StructType.fromDDL(f"x {result}")["x"].dataType),
            T.StructField("error", T.StringType()),
        ]
    )
    wanted = list(features)

    def scored(batch: pd.DataFrame) -> tuple[list, list]:
        try:
            values = list(predict(batch[wanted]))
            if len(values) != len(batch):
                raise ValueError(f"{len(values)} predictions for {len(batch)} rows")
            return values, [None] * len(batch)
        except Exception as problem:  # a failing model is data, not a failed job
            if len(batch) == 1:
                return [None], [f"{type(problem).__name__}: {problem}"]
            half = len(batch) // 2
            first, second = scored(batch.iloc[:half]), scored(batch.iloc[half:])
            return first[0] + second[0], first[1] + second[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values, errors = scored(batch)
                yield batch.assign(prediction=values, error=errors)

    return df.mapInPandas(run, schema)


Step = Callable[[DataFrame], DataFrame]


def predict_between(
    df: DataFrame,
    predict: Callable[[pd.DataFrame], Sequence],
    features: Sequence[str],
    preprocess: Step | None = None,
    postprocess: Step | None = None,
    result: str = "double",
) -> DataFrame:
    """:func:`predict_with` between two steps from table to table; a missing step changes nothing.

    ``postprocess`` sees failed rows as well: their ``prediction`` is null.
    """
    ready = df.transform(preprocess) if preprocess else df
    scored = predict_with(ready, predict, features, result)
    return scored.transform(postprocess) if postprocess else scored
