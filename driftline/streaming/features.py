"""The latest feature row of every entity, kept up to date from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.operators.asof import FeatureView, online_features
from driftline.streaming.tables import BatchWriter


def online_writer(view: FeatureView, path: str) -> BatchWriter:
    """Writer for a micro-batch: its latest row per entity, under the batch's number.

    Only entities seen in the batch are written; nothing old is rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        extra = [c for c in view.tie if c not in (*view.entity, view.timestamp, *view.fields)]
        latest = online_features(
            FeatureView(
                view.name,
                view.entity,
                {**view.fields, **{c: batch.schema[c].dataType.simpleString() for c in extra}},
                view.timestamp,
                view.ttl_seconds,
                tie=view.tie,
            ),
            batch,
        )
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_online(spark: SparkSession, view: FeatureView, path: str) -> DataFrame:
    """The newest row per entity over all batches."""
    return online_features(view, spark.read.parquet(path))
