"""Structured log lines: parsing, traces, step durations, errors, run status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()

LINE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", _S),
        T.StructField("level", _S),
        T.StructField("logger", _S),
        T.StructField("message", _S),
        T.StructField("service", _S),
        T.StructField("correlation_id", _S),
        T.StructField(
            "location",
            T.StructType(
                [
                    T.StructField("file", _S),
                    T.StructField("line", T.LongType()),
                    T.StructField("function", _S),
                ]
            ),
        ),
        T.StructField(
            "thread", T.StructType([T.StructField("id", T.LongType()), T.StructField("name", _S)])
        ),
        T.StructField("extra", T.MapType(_S, _S)),
        T.StructField(
            "exception",
            T.StructType(
                [
                    T.StructField("type", _S),
                    T.StructField("message", _S),
                    T.StructField("traceback", _S),
                ]
            ),
        ),
        T.StructField("_bad", _S),
    ]
)


def parse_logs(lines: DataFrame, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One column per field; a line that is not JSON keeps its text in ``quarantine``."""
    parsed = F.from_json(
        line, LINE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    return (
        lines.select(*keep, parsed.alias("l"))
        .select(*keep, "l.*")
        .withColumnRenamed("_bad", "quarantine")
        .withColumn("timestamp", F.try_to_timestamp("timestamp"))
    )


def trace(logs: DataFrame, correlation_id: str | Column) -> DataFrame:
    """All lines of one run, in order of time."""
    return logs.filter(F.col("correlation_id") == correlation_id).orderBy("timestamp")


def traces(logs: DataFrame) -> DataFrame:
    """Per run: lines, first and last time, errors."""
    return (
        logs.filter(F.col("correlation_id").isNotNull())
        .groupBy("correlation_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
            F.count_if(F.upper("level") == "ERROR").alias("errors"),
        )
    )


def _event() -> Column:
    return F.element_at("extra", "event")


def step_durations(logs: DataFrame) -> DataFrame:
    """Start, end and seconds per (run, step), paired by one aggregation.

    A step that did not complete has no end and no duration.
    """
    step, event = F.element_at("extra", "step"), _event()
    started = F.min(F.when(event == "step_start", F.col("timestamp")))
    completed = F.max(F.when(event == "step_complete", F.col("timestamp")))
    return (
        logs.filter(event.isin("step_start", "step_complete"))
        .groupBy("correlation_id", step.alias("step"))
        .agg(started.alias("started"), completed.alias("completed"))
        .withColumn(
            "seconds",
            (F.unix_micros("completed") - F.unix_micros("started")) / F.lit(1_000_000.0),
        )
    )


def step_errors(logs: DataFrame) -> DataFrame:
    """Errors by step and error type."""
    return (
        logs.filter(_event() == "step_error")
        .groupBy(
            F.element_at("extra", "step").alias("step"),
            F.coalesce(F.element_at("extra", "error_type"), F.col("exception.type")).alias(
                "error_type"
            ),
        )
        .agg(F.count(F.lit(1)).alias("errors"))
    )


def namespace_filter(logs: DataFrame, allowed: Sequence[str], column: str = "namespace") -> DataFrame:
    return logs.filter(F.col(column).isin(*allowed))


# Final states of a run.
RUN_STATES = ("Succeeded", "Failed", "Error")


def run_status(
    runs: DataFrame, labels: Sequence[str], status: str, ts: str, interval: str
) -> DataFrame:
    """Runs per interval and final state, one column per state, and runs still going."""
    return runs.groupBy(*labels, F.window(ts, interval).getField("start").alias("interval_start")).agg(
        *[F.count_if(F.col(status) == s).alias(s.lower()) for s in RUN_STATES],
        F.count_if(F.col(status) == "Running").alias("running"),
    )


def metric_trend(runs: DataFrame, metric: str, ts: str = "ts") -> DataFrame:
    """A metric of every run with its time, in no particular order."""
    value = F.element_at("metrics", metric)
    return runs.filter(value.isNotNull()).select("model", "run_id", ts, value.alias(metric))
