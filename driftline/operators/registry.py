"""Model registry and governance checks over run, version and deployment tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.errors import RegistrationError, ThresholdError
from driftline.functions.segments import row_numbers

# What may be served, and the governed stages.
FETCHABLE = "^(s3|gs|abs|https|http|pvc)://"
STAGES = ("staging", "production", "archived")
VERSION_FORMAT = r"^[0-9]+(\.[0-9]+\.[0-9]+)?$"
MUTABLE_TAGS = (":latest", ":main")


# --- registration -------------------------------------------------------------


def registration_gate(
    runs: DataFrame, threshold: float, metric: str = "accuracy", strict: bool = False
) -> DataFrame:
    """Adds ``value`` and ``decision``: registered, below_threshold or missing_metric.

    With ``strict`` a run without the metric is an error instead of a row.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ThresholdError(f"threshold must be between 0 and 1, got {threshold}")
    value = F.element_at("metrics", metric)
    out = runs.withColumns(
        {
            "value": value,
            "decision": F.when(value.isNull(), "missing_metric")
            .when(value >= threshold, "registered")
            .otherwise("below_threshold"),
        }
    )
    if strict and not out.filter(F.col("decision") == "missing_metric").isEmpty():
        raise RegistrationError(f"runs without the metric {metric}")
    return out


def assign_versions(
    registered: DataFrame, model: str = "model", ts: str = "ts", tie: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Adds ``version``: 1, 2, 3 ... per model in order of registration."""
    return row_numbers(registered, [model], ts, tie, "version")


def assign_alias(versions: DataFrame, alias: str, model: str = "model") -> DataFrame:
    """``(model, alias, version)``: the alias points to the newest version."""
    return versions.groupBy(model).agg(F.max("version").alias("version")).select(
        model, F.lit(alias).alias("alias"), "version"
    )


def resolve_alias(aliases: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """model@alias to version, run, experiment and source, with ``status``.

    A run that cannot be found leaves the experiment empty. A source that
    serving cannot fetch is ``unfetchable``; an alias to a missing version is
    ``unresolved``.
    """
    found = aliases.join(
        versions.select("model", "version", "run_id", "source"), ["model", "version"], "left"
    ).join(runs.select("run_id", "experiment_id"), "run_id", "left")
    source = F.coalesce("source", F.lit(""))
    return found.select(
        "model",
        "alias",
        "version",
        F.coalesce("run_id", F.lit("")).alias("run_id"),
        F.coalesce("experiment_id", F.lit("")).alias("experiment_id"),
        F.col("source").alias("storage_uri"),
        F.when(F.col("source").isNull(), "unresolved")
        .when(source.rlike(FETCHABLE), "resolved")
        .otherwise("unfetchable")
        .alias("status"),
    )


# --- deployment policies ------------------------------------------------------


@dataclass(frozen=True)
class LabelNames:
    """Names of labels and annotations; ``prefix`` is put before each."""

    prefix: str = ""

    def __call__(self, name: str) -> str:
        return f"{self.prefix}{name}"


def _filled(values: Column, key: str) -> Column:
    """The key is present with at least one character."""
    return F.coalesce(F.length(F.element_at(values, key)) > 0, F.lit(False))


def policy_results(deployments: DataFrame, names: LabelNames = LabelNames()) -> DataFrame:
    """``(name, rule, result)`` with pass, fail or skip for every deployment and rule.

    Deployments have the maps ``labels`` and ``annotations`` (null = empty).
    """
    empty = F.create_map().cast("map<string,string>")
    labels = F.coalesce("labels", empty)
    notes = F.coalesce("annotations", empty)

    def all_of(values: Column, keys: Sequence[str]) -> Column:
        out = F.lit(True)
        for key in keys:
            out = out & _filled(values, names(key))
        return out

    stage = F.coalesce(F.element_at(labels, names("model-stage")), F.lit(""))
    production = stage == "production"
    version = F.coalesce(F.element_at(labels, names("model-version")), F.lit("0"))
    rules = {
        "require-model-labels": (
            F.lit(True),
            all_of(labels, ("model-name", "model-version", "model-owner")) & stage.isin(*STAGES),
        ),
        "require-approval-for-production": (
            production,
            all_of(notes, ("approved-by", "approval-date", "approval-ticket")),
        ),
        "require-lineage": (F.lit(True), all_of(notes, ("experiment-id", "run-id"))),
        "require-performance-metrics": (
            production,
            _filled(notes, names("accuracy")) | _filled(notes, names("f1-score")),
        ),
        "validate-version-format": (F.lit(True), version.rlike(VERSION_FORMAT)),
    }
    results = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.when(~applies, "skip").when(passed, "pass").otherwise("fail").alias("result"),
            )
            for rule, (applies, passed) in rules.items()
        ]
    )
    return deployments.select("name", F.inline(results))


def audit_log(changes: DataFrame, names: LabelNames = LabelNames()) -> DataFrame:
    """One row per CREATE or UPDATE; missing labels read ``unknown``."""
    def label(key: str) -> Column:
        value = F.element_at("labels", names(key))
        return F.when(F.coalesce(F.length(value), F.lit(0)) > 0, value).otherwise("unknown")

    return changes.filter(F.col("operation").isin("CREATE", "UPDATE")).select(
        "name",
        label("model-name").alias("model_name"),
        label("model-version").alias("model_version"),
        label("model-owner").alias("model_owner"),
        label("model-stage").alias("model_stage"),
        F.col("username").alias("deployed_by"),
        F.col("ts").alias("deployed_at"),
        "operation",
    )


def denied_deletes(changes: DataFrame, names: LabelNames = LabelNames()) -> DataFrame:
    """Deletions of production models, which must be archived first."""
    stage = F.coalesce(F.element_at("labels", names("model-stage")), F.lit(""))
    return changes.filter((F.col("operation") == "DELETE") & (stage == "production"))


def _images(pods: DataFrame, keys: Sequence[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    every = F.concat(
        F.coalesce("containers", none),
        F.coalesce("init_containers", none) if "init_containers" in pods.columns else none,
    )
    return pods.select(*keys, F.explode(every).alias("image"))


def mutable_images(pods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Containers and init containers whose image has a tag that can move."""
    bad = F.lit(False)
    for tag in MUTABLE_TAGS:
        bad = bad | F.col("image").endswith(tag)
    return _images(pods, keys).filter(bad)


def external_images(pods: DataFrame, keys: Sequence[str], trusted: str) -> DataFrame:
    """Images that do not come from the trusted registry."""
    return _images(pods, keys).filter(~F.col("image").startswith(trusted))


def supply_chain(artifacts: DataFrame) -> DataFrame:
    """Adds ``verdict`` to models with ``revision`` and a ``files`` array."""
    unsafe = F.exists(
        F.coalesce("files", F.array().cast("array<string>")), lambda f: f.endswith(".bin")
    )
    return artifacts.withColumn(
        "verdict",
        F.when(F.coalesce(F.length("revision"), F.lit(0)) == 0, "rejected: no revision")
        .when(unsafe, "rejected: unsafe weights")
        .otherwise("accepted"),
    )
