"""Continuous forms of the SLO, alert, session and step operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value of our own: how late a row may come. The source assumes order.
LATENESS = "10 minutes"


def request_buckets(
    stream: DataFrame,
    is_bad: Column,
    labels: Sequence[str],
    step: str = "5 minutes",
    ts: str = "ts",
    lateness: str = LATENESS,
) -> DataFrame:
    """Requests and bad requests per (labels, tumbling step); ``ts`` is the step's end."""
    counted = (
        stream.withWatermark(ts, lateness)
        .groupBy(*labels, F.window(ts, step).alias("_w"))
        .agg(F.count_if(is_bad).alias("bad"), F.count(F.lit(1)).alias("total"))
    )
    return counted.select(*labels, F.col("_w.end").alias("ts"), "bad", "total")


def sliding_rate(
    stream: DataFrame,
    labels: Sequence[str],
    window: str,
    slide: str,
    ts: str = "ts",
    lateness: str = LATENESS,
) -> DataFrame:
    """Requests in every sliding window, and per second."""
    counted = (
        stream.withWatermark(ts, lateness)
        .groupBy(*labels, F.window(ts, window, slide).alias("_w"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    seconds = F.unix_timestamp("_w.end") - F.unix_timestamp("_w.start")
    return counted.select(
        *labels, F.col("_w.end").alias("ts"), "requests", (F.col("requests") / seconds).alias("rate")
    )


def alert_sessions(
    stream: DataFrame,
    by: Sequence[str],
    gap: str,
    ts: str = "ts",
    lateness: str = LATENESS,
) -> DataFrame:
    """Alerts grouped until none comes for ``gap``; a group is given out once it is over.

    Filter the written table, not this frame: Spark would move a filter on
    ``started`` or ``ended`` before the rows are joined into sessions.
    """
    grouped = (
        stream.withWatermark(ts, lateness)
        .groupBy(*by, F.session_window(ts, gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("alerts"))
    )
    return grouped.select(
        *by, F.col("_w.start").alias("started"), F.col("_w.end").alias("ended"), "alerts"
    )


def _output(labels: Sequence[str], df: DataFrame, more: list[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[c] for c in labels] + more)


def _forget_at(state: GroupState, until: pd.Timestamp) -> None:
    """Lets the state end once the watermark has passed ``until``."""
    state.setTimeoutTimestamp(max(until.value // 1_000_000, state.getCurrentWatermarkMs()) + 1)


def hold(
    stream: DataFrame,
    labels: Sequence[str],
    condition: Column,
    for_seconds: int,
    step_seconds: int,
    ts: str = "ts",
    late: str = LATENESS,
) -> DataFrame:
    """Streaming :func:`driftline.operators.series.hold`.

    Input: one row per (labels, evaluation instant), in order across
    micro-batches; rows behind the watermark are dropped. State: start and last
    instant of the current run, forgotten when the watermark is past the run.
    """
    labels = list(labels)
    output = _output(
        labels,
        stream,
        [
            T.StructField(ts, T.TimestampType()),
            T.StructField("active_since", T.TimestampType()),
            T.StructField("state", T.StringType()),
        ],
    )
    step, wanted = pd.Timedelta(seconds=step_seconds), pd.Timedelta(seconds=for_seconds)

    def run(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # a later row starts a new run anyway
            state.remove()
            return
        times = sorted(t for b in batches for t in b[ts])
        since_us, last_us = state.get if state.exists else (None, None)
        since = None if since_us is None else pd.Timestamp(since_us, unit="us")
        last = None if last_us is None else pd.Timestamp(last_us, unit="us")
        rows = []
        for now in times:
            if last is None or now - last > step:
                since = now
            last = now
            rows.append((*key, now, since, "firing" if now - since >= wanted else "pending"))
        if rows:
            state.update((since.value // 1000, last.value // 1000))
            _forget_at(state, last + step)
            yield pd.DataFrame(rows, columns=output.names)

    return (
        stream.withWatermark(ts, late)
        .filter(condition)
        .select(*labels, ts)
        .groupBy(*labels)
        .applyInPandasWithState(
            run, output, "since long, last long", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def throttle(
    stream: DataFrame, by: Sequence[str], repeat_seconds: int, ts: str = "ts", late: str = LATENESS
) -> DataFrame:
    """The first alert of a group, and then one whenever ``repeat_seconds`` have passed since the last.

    Rows behind the watermark are dropped; a group is forgotten when the
    watermark is so far past its last alert that the next one is sent anyway.
    """
    by = list(by)
    output = _output(by, stream, [T.StructField(ts, T.TimestampType())])
    wait = pd.Timedelta(seconds=repeat_seconds)

    def run(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for b in batches for t in b[ts])
        sent = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = []
        for now in times:
            if sent is None or now - sent >= wait:
                sent = now
                rows.append((*key, now))
        if rows:
            state.update((sent.value // 1000,))
        if sent is not None:
            _forget_at(state, sent + wait)
        if rows:
            yield pd.DataFrame(rows, columns=output.names)

    return (
        stream.withWatermark(ts, late)
        .select(*by, ts)
        .groupBy(*by)
        .applyInPandasWithState(run, output, "sent long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def step_durations(
    stream: DataFrame,
    run: str = "correlation_id",
    step: str = "step",
    event: str = "event",
    ts: str = "timestamp",
    longest: str = "1 day",
    lateness: str = LATENESS,
) -> DataFrame:
    """Steps paired start to end by a stream join; a start is kept for ``longest``."""
    started = (
        stream.filter(F.col(event) == "step_start")
        .select(F.col(run).alias("run"), F.col(step).alias("step"), F.col(ts).alias("started"))
        .withWatermark("started", lateness)
    )
    completed = (
        stream.filter(F.col(event) == "step_complete")
        .select(
            F.col(run).alias("_run"), F.col(step).alias("_step"), F.col(ts).alias("completed")
        )
        .withWatermark("completed", lateness)
    )
    paired = started.join(
        completed,
        (F.col("run") == F.col("_run"))
        & (F.col("step") == F.col("_step"))
        & (F.col("completed") >= F.col("started"))
        & (F.col("completed") <= F.col("started") + F.expr(f"INTERVAL {longest}")),
    )
    seconds = (F.unix_micros("completed") - F.unix_micros("started")) / F.lit(1_000_000.0)
    return paired.select("run", "step", "started", "completed", seconds.alias("seconds"))
