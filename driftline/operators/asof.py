"""Feature views: point-in-time features for training, latest features for serving."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.errors import MissingColumnError
from driftline.functions.scalars import join_on_keys
from driftline.functions.segments import CHUNK_ROWS, HOT_ROWS, latest_before
from driftline.session import materialise

# Fixed value: default time to live of a feature row, in seconds (7 days).
TTL_SECONDS = 7 * 86_400


@dataclass(frozen=True)
class FeatureView:
    """Typed feature columns of a timestamped source, keyed by an entity."""

    name: str
    entity: tuple[str, ...]
    fields: Mapping[str, str] = field(default_factory=dict)
    timestamp: str = "event_timestamp"
    ttl_seconds: int = TTL_SECONDS
    path: str | None = None
    tie: tuple[str, ...] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        """The view's parquet source, reduced to key, time and fields."""
        return self.shape(spark.read.parquet(self.path))

    def shape(self, source: DataFrame) -> DataFrame:
        missing = [
            c for c in (*self.entity, self.timestamp, *self.fields) if c not in source.columns
        ]
        if missing:
            raise MissingColumnError(f"feature view {self.name} lacks {missing}")
        extra = [c for c in self.tie if c not in (*self.entity, self.timestamp, *self.fields)]
        return source.select(
            *self.entity,
            F.col(self.timestamp).cast("timestamp").alias(self.timestamp),
            *[F.col(c).cast(t).alias(c) for c, t in self.fields.items()],
            *extra,
        )


def refs_of(view: FeatureView, refs: Sequence[str]) -> list[str]:
    """Field names among ``view:field`` references that belong to the view."""
    split = [r.split(":", 1) for r in refs]
    wanted = [f for v, f in split if v == view.name]
    unknown = [f for f in wanted if f not in view.fields]
    if unknown:
        raise MissingColumnError(f"feature view {view.name} has no fields {unknown}")
    return wanted


def historical_features(
    entities: DataFrame,
    sources: Sequence[tuple[FeatureView, DataFrame]],
    refs: Sequence[str],
    entity_ts: str = "event_timestamp",
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Entity rows with each view's latest feature values at the row's time.

    A feature row counts from its own time until its view's time to live has
    passed; without one the fields are null.
    """
    out = entities
    for view, source in sources:
        wanted = refs_of(view, refs)
        if not wanted:
            continue
        found = latest_before(
            out,
            view.shape(source),
            view.entity,
            entity_ts,
            view.timestamp,
            view.tie,
            hot_rows,
            chunk_rows,
        )
        age = F.unix_micros(entity_ts) - F.unix_micros(F.col("fact")[view.timestamp])
        alive = age <= view.ttl_seconds * 1_000_000
        out = found.select(
            *out.columns, *[F.when(alive, F.col("fact")[c]).alias(c) for c in wanted]
        )
    return out


def online_features(
    view: FeatureView,
    source: DataFrame,
    refs: Sequence[str] | None = None,
    keys: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """The latest feature row of every entity, or of the given entity keys."""
    shaped = view.shape(source)
    if as_of is not None:
        age = F.unix_micros(as_of) - F.unix_micros(view.timestamp)
        shaped = shaped.filter((age >= 0) & (age <= view.ttl_seconds * 1_000_000))
    if keys is not None:
        # Written, so that its size is known: a short list is broadcast to the scan.
        keys = materialise(keys.select(*view.entity).distinct(), "online-keys")
        shaped = join_on_keys(shaped, keys, view.entity, "left_semi")
    wanted = refs_of(view, refs) if refs is not None else list(view.fields)
    latest = shaped.groupBy(*view.entity).agg(
        F.max_by(F.struct(view.timestamp, *wanted), F.struct(view.timestamp, *view.tie)).alias("f")
    )
    out = latest.select(*view.entity, "f.*")
    if keys is not None:
        out = join_on_keys(keys, out, view.entity, "left")
    return out
