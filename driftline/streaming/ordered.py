"""Stateful hold and throttle in event-time order, for rows that come out of order.

Instants of a key wait in the state store, packed by time slot, until the
watermark has passed their slot; a timer then hands the slot to the operator.
So the result does not depend on how rows fall into micro-batches as long as
none is later than the lateness, and no key's micro-batch is held in memory:
a task holds at most ``PACK`` instants that have just come in and one slot of
one key (eight bytes an instant).

Rows of the last slots are given out when the watermark passes them; a stream
that ends needs a closing row (:func:`closing_rows`). Null instants take no part,
repeated instants of a key count once, null labels are a key like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from driftline.streaming.monitoring import LATENESS

# Fixed values of our own: instants that wait together, and the longest slot.
PACK = 1 << 17
SLOT_SECONDS = 600

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, as these operators need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def closing_rows(seen: DataFrame, ts: str, late_seconds: int, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row without labels that moves the watermark past every row of ``seen``.

    Feed it after all others, through the same watermark and before any filter.
    Its own slot stays open, so it shows in no result.
    """
    far = F.max(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(late_seconds + 2 * slot_seconds))
    row = seen.agg(far.alias(ts)).filter(F.col(ts).isNotNull())
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in seen.schema.fields if f.name != ts]
    return row.select(ts, *others).select(*seen.columns)


class _InTimeOrder(StatefulProcessor):
    """Keeps instants by slot and meets the slots of a key in time order."""

    run_schema = ""

    def __init__(self, slot_us: int) -> None:
        self.slot_us = slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slot long, part int", "instants binary")
        self.counts = handle.getMapState("counts", "slot long", "parts int")
        self.run = handle.getValueState("run", self.run_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting: list[np.ndarray] = []
        held = 0
        for frame in rows:
            waiting.append(frame.iloc[:, -1].to_numpy(np.int64))  # columns come without names
            held += len(waiting[-1])
            if held >= PACK:
                self._keep(np.unique(np.concatenate(waiting)))
                waiting, held = [], 0
        if held:
            self._keep(np.unique(np.concatenate(waiting)))
        return iter(())

    def _keep(self, instants: np.ndarray) -> None:
        slots, starts = np.unique(instants // self.slot_us, return_index=True)
        for slot, part in zip(slots.tolist(), np.split(instants, starts[1:])):
            n = 0
            if self.counts.containsKey((slot,)):
                n = self.counts.getValue((slot,))[0]
            else:
                self._wake(slot)
            self.parts.updateValue((slot, n), (part.tobytes(),))
            self.counts.updateValue((slot,), (n + 1,))

    def _wake(self, slot: int) -> None:
        self.handle.registerTimer(-(-(slot + 1) * self.slot_us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.slot_us - 1
        state = tuple(self.run.get()) if self.run.exists() else None
        if not self.counts.containsKey((slot,)):
            # Nothing came in this slot: it was watched for the end of the run.
            if state is not None and self.over(state, (slot + 1) * self.slot_us):
                self.run.clear()
            return
        n = self.counts.getValue((slot,))[0]
        parts = (np.frombuffer(self.parts.getValue((slot, i))[0], np.int64) for i in range(n))
        state, columns = self.slot(state, parts)
        for i in range(n):
            self.parts.removeKey((slot, i))
        self.counts.removeKey((slot,))
        if state is not None:
            self.run.update(state)
            watch = self.until(state) // self.slot_us + 1
            if not self.counts.containsKey((watch,)):
                self._wake(watch)
        if columns and len(columns[0][1]):
            frame = {name: [value] * len(columns[0][1]) for name, value in zip(self.labels, key)}
            yield pd.DataFrame({**frame, **dict(columns)})

    def over(self, state: tuple, now: int) -> bool:
        return self.until(state) < now


class _Hold(_InTimeOrder):
    run_schema = "since long, last long"

    def __init__(self, labels: Sequence[str], ts: str, wanted: int, step: int, slot: int) -> None:
        super().__init__(slot)
        self.labels, self.ts, self.wanted, self.step = list(labels), ts, wanted, step

    def until(self, state: tuple) -> int:
        return state[1] + self.step

    def slot(self, state, parts):
        now = np.unique(np.concatenate(list(parts)))
        before = np.concatenate([[now[0] if state is None else state[1]], now[:-1]])
        starts = now - before > self.step
        starts[0] |= state is None
        first = now[0] if state is None else state[0]
        which = np.maximum.accumulate(np.where(starts, np.arange(len(now)), -1))
        since = np.where(which < 0, first, now[np.maximum(which, 0)])
        firing = np.where(now - since >= self.wanted, "firing", "pending")
        rows = [(self.ts, now), ("active_since", since), ("state", firing)]
        return (int(since[-1]), int(now[-1])), rows


class _Throttle(_InTimeOrder):
    run_schema = "sent long"

    def __init__(self, labels: Sequence[str], ts: str, wait: int, slot: int) -> None:
        super().__init__(min(slot, wait))  # so that a slot sends one at most
        self.labels, self.ts, self.wait = list(labels), ts, wait

    def until(self, state: tuple) -> int:
        return state[0] + self.wait

    def slot(self, state, parts):
        due = None
        for part in parts:
            at = 0 if state is None else np.searchsorted(part, state[0] + self.wait)
            if at < len(part):
                due = part[at] if due is None else min(due, part[at])
        if due is None:
            return state, []
        return (int(due),), [(self.ts, np.array([due]))]


def _here(condition: Column) -> Column:
    """The condition, kept above the watermark.

    Spark moves a filter below it, where rows that do not match no longer move
    the watermark; one that is not deterministic (and no conjunction) stays.
    """
    return F.coalesce(condition, F.lit(False)) == (F.spark_partition_id() >= 0)


def _grouped(
    seen: DataFrame, labels: list[str], ts: str, processor: _InTimeOrder, times: list[str], more: str = ""
) -> DataFrame:
    """Instants go through Python as microseconds, so that no time zone comes in."""
    output = T.StructType([seen.schema[c] for c in labels])
    for name in times:
        output.add(name, T.LongType())
    if more:
        output.add(more, T.StringType())
    out = (
        seen.filter(F.col(ts).isNotNull())
        .select(*labels, ts, F.unix_micros(ts).alias("_us"))
        .groupBy(*labels)
        .transformWithStateInPandas(processor, output, "Append", "EventTime")
    )
    return out.withColumns({name: F.timestamp_micros(name) for name in times})


def hold(
    stream: DataFrame,
    labels: Sequence[str],
    condition: Column,
    for_seconds: int,
    step_seconds: int,
    ts: str = "ts",
    late: str = LATENESS,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """:func:`driftline.operators.series.hold` of a stream whose rows come in any order.

    Rows later than ``late`` are dropped and counted. Start it inside :func:`rocksdb`.
    """
    labels = list(labels)
    us = 1_000_000
    processor = _Hold(labels, ts, for_seconds * us, step_seconds * us, slot_seconds * us)
    due = stream.withWatermark(ts, late).filter(_here(condition))
    return _grouped(due, labels, ts, processor, [ts, "active_since"], "state")


def throttle(
    stream: DataFrame,
    by: Sequence[str],
    repeat_seconds: int,
    condition: Column | None = None,
    ts: str = "ts",
    late: str = LATENESS,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """The first alert of a group, then one whenever ``repeat_seconds`` have passed, in time order.

    Alerts are the rows for which ``condition`` holds; all rows move the watermark.
    ``repeat_seconds`` is one at least.
    """
    if repeat_seconds < 1:
        raise ValueError("repeat_seconds must be at least 1")
    by = list(by)
    processor = _Throttle(by, ts, repeat_seconds * 1_000_000, slot_seconds * 1_000_000)
    seen = stream.withWatermark(ts, late)
    alerts = seen if condition is None else seen.filter(_here(condition))
    return _grouped(alerts, by, ts, processor, [ts])
