"""Training, gates and scoring over embeddings, labelled documents and events."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import align_down
from driftline.operators import features, model
from driftline.plans.registry import at_edge, query, table

TREES, DEPTH = model.TREES, model.DEPTH


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return rows.select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"), "label"
    )


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return model.use_upstream_split(vectors(spark, sf), "label", "vec_id")


@query(
    "upstream_split",
    """WITH h AS (SELECT vec_id, label, ('0x' || substr(sha256(vec_id::VARCHAR || '|42'), 1, 15))::BIGINT AS h FROM embeddings),
    s AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY h) > ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS tr FROM h)
    SELECT label, count(*) FILTER (tr) AS train, count(*) FILTER (NOT tr) AS held_out FROM s GROUP BY label""",
)
def upstream_split(spark: SparkSession, sf: str) -> DataFrame:
    train, held_out = _split(spark, sf)
    marked = train.select("label", F.lit(True).alias("t")).unionAll(
        held_out.select("label", F.lit(False).alias("t"))
    )
    return marked.groupBy("label").agg(
        F.count_if("t").alias("train"), F.count_if(~F.col("t")).alias("held_out")
    )


@query("forest_scores")
def forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, held_out = _split(spark, sf)
    fitted = model.train_forest(train, "vector", "label", TREES, DEPTH)
    return at_edge(
        model.batch_score(held_out, fitted).select("vec_id", "label", "prediction", "score")
    )


@query("forest_quality")
def forest_quality(spark: SparkSession, sf: str) -> DataFrame:
    train, held_out = _split(spark, sf)
    fitted = model.train_forest(train, "vector", "label", TREES, DEPTH)
    scored = model.batch_score(held_out, fitted).withColumn("label", F.col("label").cast("string"))
    return at_edge(model.evaluate(scored, "label"))


@query(
    "fold_sizes",
    """WITH h AS (SELECT vec_id, label, ('0x' || substr(sha256(vec_id::VARCHAR || '|42'), 1, 15))::BIGINT AS h FROM embeddings),
    f AS (SELECT label, ((row_number() OVER (PARTITION BY label ORDER BY h) - 1) % 5)::INT AS fold FROM h)
    SELECT label, fold, count(*) AS rows FROM f GROUP BY 1, 2""",
)
def fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every class in every fold."""
    folds = model.stratified_folds(vectors(spark, sf), "label", "vec_id")
    return folds.groupBy("label", F.col("_fold").alias("fold")).agg(F.count(F.lit(1)).alias("rows"))


@query("cv_scores")
def cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(spark, sf)
    return model.cross_validate(train, "vector", "label", "vec_id")


@query("grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(spark, sf)
    return model.grid_search(train, "vector", "label", "vec_id")[1]


@query("feature_importance")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Impurity and permutation importance of every embedding dimension."""
    train, held_out = _split(spark, sf)
    fitted = model.train_forest(train, "vector", "label", TREES, DEPTH)
    names = [str(i) for i in range(64)]
    impurity = model.forest_importance(fitted, spark, names).withColumn(
        "position", F.col("feature").cast("int")
    )
    lost = model.permutation_importance(fitted, held_out, "vector", "label", "vec_id", 64)
    return impurity.join(lost.withColumnRenamed("importance", "accuracy_lost"), "position").select(
        "position", "importance", "accuracy_lost"
    )


@query("cv_summary")
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(spark, sf)
    folds = model.cross_validate(train, "vector", "label", "vec_id")
    return model.cross_validation_summary(folds)


# --- checkable with a rule as the model ---------------------------------------

_RULE = """h AS (SELECT doc_id, quality, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS prediction, lang,
  ('0x' || substr(sha256(doc_id::VARCHAR || '|42'), 1, 15))::BIGINT AS h FROM labels JOIN documents USING (doc_id)),
p AS (SELECT *, (row_number() OVER (PARTITION BY quality ORDER BY h) > ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY quality)))::INT AS is_train FROM h)"""


def rule_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels with the length rule as prediction, and a held-out fifth."""
    documents = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    joined = table(spark, sf, "labels").select("doc_id", "quality").join(documents, "doc_id")
    rule = F.when(F.col("n_chars") > 400, 1).otherwise(0)
    predicted = joined.select("doc_id", "quality", rule.alias("prediction"), "lang")
    return features.stratified_split(predicted, "quality", "doc_id")


@query(
    "classification_metrics",
    f"""WITH {_RULE}, t AS (SELECT * FROM p WHERE is_train = 0),
    c AS (SELECT k, count(*) FILTER (quality = k AND prediction = k) AS hit, count(*) FILTER (quality = k) AS support,
      count(*) FILTER (prediction = k) AS predicted FROM t, (VALUES (0), (1)) v(k) GROUP BY k)
    SELECT sum(support)::BIGINT AS rows, round(sum(hit) / sum(support), 6) AS accuracy,
      round(sum(CASE WHEN support + predicted > 0 THEN 2 * hit / (support + predicted) * support ELSE 0 END) / sum(support), 6) AS f1_score FROM c""",
)
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    held_out = rule_predictions(spark, sf).filter("is_train = 0")
    return at_edge(model.evaluate(held_out, "quality"))


@query(
    "confusion",
    f"WITH {_RULE} SELECT quality AS label, prediction, count(*) AS n FROM p GROUP BY 1, 2",
)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return model.confusion(rule_predictions(spark, sf), "quality")


@query(
    "model_gate",
    f"""WITH {_RULE}, g AS (SELECT count(*) AS rows, count(*) FILTER (prediction IS NULL) AS prediction_failures,
      count(DISTINCT prediction) AS classes_predicted, avg((prediction = quality)::INT) AS accuracy FROM p WHERE is_train = 0)
    SELECT rows, prediction_failures, classes_predicted, round(accuracy, 6) AS accuracy, accuracy >= 0.6 AS accuracy_threshold,
      classes_predicted >= 2 AS class_diversity, prediction_failures = 0 AS predictions_ok,
      accuracy >= 0.6 AND classes_predicted >= 2 AND prediction_failures = 0 AS passed FROM g""",
)
def model_gate(spark: SparkSession, sf: str) -> DataFrame:
    gate = model.model_gate(rule_predictions(spark, sf), "quality", 0.6)
    checks = ("accuracy_threshold", "class_diversity", "predictions_ok")
    return at_edge(
        gate.select(
            "rows",
            "prediction_failures",
            "classes_predicted",
            "accuracy",
            *[F.col("checks")[c].alias(c) for c in checks],
            "passed",
        )
    )


@query(
    "check_outputs",
    """WITH o AS (SELECT event_type AS endpoint, CASE WHEN user_id % 50 <> 7 THEN event_type END AS label, value / 485 AS score, value / 1000 AS latency,
      CASE WHEN user_id % 40 = 3 THEN 'failed' END AS error FROM events),
    g AS (SELECT endpoint, count(*) FILTER (error IS NULL) AS num_successful, count(*) FILTER (error IS NOT NULL) AS num_failed,
      count(*) FILTER (error IS NULL AND (label IS NULL OR score > 1 OR score < 0)) AS schema_failures,
      coalesce(avg(latency) FILTER (error IS NULL), 0) AS a,
      list_sort(list(latency) FILTER (error IS NULL)) AS l FROM o GROUP BY 1),
    q AS (SELECT *, l[1 + least(floor(0.95::DOUBLE * len(l)), len(l) - 1)::BIGINT] AS p FROM g)
    SELECT endpoint, num_successful, num_failed, schema_failures, round(a, 4) AS avg_latency, round(p, 4) AS p95_latency,
      num_failed = 0 AS all_inferences_passed, schema_failures = 0 AS output_schema_valid, p <= 0.3 AS latency_within_threshold,
      num_failed = 0 AND schema_failures = 0 AND p <= 0.3 AS passed FROM q""",
)
def check_outputs(spark: SparkSession, sf: str) -> DataFrame:
    outputs = table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"),
        F.when(F.col("user_id") % 50 != 7, F.col("event_type")).alias("label"),
        (F.col("value") / 485).alias("score"),
        (F.col("value") / 1000).alias("latency"),
        F.when(F.col("user_id") % 40 == 3, "failed").alias("error"),
    )
    return model.check_outputs(outputs, ["endpoint"], 0.3)


@query(
    "check_batch_counts",
    """WITH u AS (SELECT conv_id, count(*) AS asked FROM conversations WHERE role = 'user' GROUP BY 1),
    a AS (SELECT conv_id, count(*) AS answered FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT conv_id, asked, coalesce(answered, 0) AS answered, coalesce(answered, 0) > 0 AND answered = asked AS ok FROM u LEFT JOIN a USING (conv_id)""",
)
def check_batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")

    def counted(role: str) -> DataFrame:
        return turns.filter(F.col("role") == role).groupBy("conv_id").agg(
            F.count(F.lit(1)).alias("rows")
        )

    return model.check_batch_counts(counted("user"), counted("assistant"), "conv_id")


@query(
    "prediction_distribution",
    """WITH c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS d, event_type AS class, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT d AS ts, class, n, round(n / sum(n) OVER (PARTITION BY d), 6) AS share FROM c""",
)
def prediction_distribution(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "events")
    day = align_down(F.col("ts"), 86_400)
    return at_edge(model.prediction_distribution(scored, "event_type", day))


@query(
    "external_scores",
    "SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax, 6) AS prediction, NULL::VARCHAR AS error FROM lineitem",
)
def external_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A model given as a function of a pandas frame."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    scored = model.predict_with(
        rows, lambda frame: frame["l_quantity"] * 2 + frame["l_tax"], ["l_quantity", "l_tax"]
    )
    return at_edge(scored.drop("l_quantity", "l_tax"))


@query(
    "failing_model",
    "SELECT vec_id, NULL::DOUBLE AS prediction, 'RuntimeError: degraded model' AS error FROM embeddings",
)
def failing_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model that always raises gives rows with an error, not a failed job."""

    def degraded(frame):
        raise RuntimeError("degraded model")

    return model.predict_with(table(spark, sf, "embeddings").select("vec_id"), degraded, ["vec_id"])


@query(
    "hooked_scores",
    """SELECT l_orderkey, l_linenumber, round(l_quantity / 50 + l_tax, 6) AS prediction,
      CASE WHEN l_quantity / 50 + l_tax >= 0.5 THEN 'high' ELSE 'low' END AS band FROM lineitem""",
)
def hooked_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A model between a step that prepares its features and one that names its answers."""

    def prepare(rows: DataFrame) -> DataFrame:
        share = (F.col("l_quantity") / 50).alias("share")
        return rows.select("l_orderkey", "l_linenumber", share, "l_tax")

    def name(rows: DataFrame) -> DataFrame:
        band = F.when(F.col("prediction") >= 0.5, "high").otherwise("low").alias("band")
        return rows.select("l_orderkey", "l_linenumber", "prediction", band)

    scored = model.predict_between(
        table(spark, sf, "lineitem"), lambda f: f["share"] + f["l_tax"], ["share", "l_tax"], prepare, name
    )
    return at_edge(scored)
