"""Streaming sinks that survive restarts, and ways to drain a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from threading import Condition
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

BatchWriter = Callable[[DataFrame, int], None]


class _LateRows(StreamingQueryListener):
    """Adds up the dropped late rows of every run as its batches end: three values per run.

    For a query with a folder the count of each batch that dropped rows is also
    written there under the batch's number; a batch that runs again after a
    failure replaces its own count.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folders: dict[str, str] = {}
        self.waiting: dict[str, dict[int, int]] = {}
        self.changed = Condition()
        self.dropped: dict[str, int] = {}
        self.batch: dict[str, int] = {}
        self.ended: set[str] = set()

    def keep(self, query: str, folder: str) -> None:
        """Writes the counts of a query from now on, and those that came before the folder was known."""
        with self.changed:
            self.folders[query] = folder
            before = self.waiting.pop(query, {})
        for batch, dropped in before.items():
            self._write(folder, batch, dropped)

    def _write(self, folder: str, batch: int, dropped: int) -> None:
        row = self.spark.createDataFrame([(dropped,)], "dropped long").coalesce(1)
        row.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    def onQueryStarted(self, event) -> None:
        with self.changed:
            self.dropped[str(event.runId)] = 0
            self.waiting[str(event.id)] = {}

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run, query = str(progress.runId), str(progress.id)
        late = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
        with self.changed:
            folder = self.folders.get(query)
            if late and folder is None and query in self.waiting:
                self.waiting[query][progress.batchId] = late
        if late and folder is not None:
            self._write(folder, progress.batchId, late)
        with self.changed:
            if run in self.dropped:
                self.dropped[run] += late
                self.batch[run] = progress.batchId
            self.changed.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.waiting.pop(str(event.id), None)
            self.folders.pop(str(event.id), None)
            self.changed.notify_all()


_late_rows: WeakKeyDictionary[SparkSession, _LateRows] = WeakKeyDictionary()


def count_late_rows(spark: SparkSession) -> None:
    """Counts the dropped late rows of the session's queries that start from now on."""
    if spark not in _late_rows:
        _late_rows[spark] = listener = _LateRows(spark)
        spark.streams.addListener(listener)


def start(
    df: DataFrame,
    writer: BatchWriter,
    checkpoint: str,
    mode: str = "update",
    interval: str | None = None,
    late: str | None = None,
) -> StreamingQuery:
    """Runs ``writer`` per micro-batch, every ``interval``; without one until the input is used up.

    ``late`` names a folder for the counts of dropped late rows (:func:`late_rows`).
    """
    count_late_rows(df.sparkSession)
    out = df.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint)
    out = out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)
    return _counted(out.start(), df.sparkSession, late)


def start_table(
    df: DataFrame, path: str, checkpoint: str, interval: str | None = None, late: str | None = None
) -> StreamingQuery:
    """Appends finished rows to a parquet table, exactly once; ``late`` as in :func:`start`."""
    count_late_rows(df.sparkSession)
    out = df.writeStream.outputMode("append").format("parquet").option("path", path)
    out = out.option("checkpointLocation", checkpoint)
    out = out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)
    return _counted(out.start(), df.sparkSession, late)


def _counted(query: StreamingQuery, spark: SparkSession, folder: str | None) -> StreamingQuery:
    if folder is not None:
        _late_rows[spark].keep(str(query.id), folder)
    return query


def drain(query: StreamingQuery) -> StreamingQuery:
    """Waits for an ``availableNow`` query and raises what it raised."""
    query.awaitTermination()
    return query


def versioned(path: str) -> BatchWriter:
    """Keeps the rows of every micro-batch under its number.

    A batch that is run again after a failure replaces its own rows, so each
    counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last version of every key that :func:`versioned` wrote."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str], target: str) -> None:
    """Writes the newest version of every key as one batch below ``target``."""
    newest(spark, path, keys).write.mode("overwrite").parquet(f"{target}/batch=0")


def guarded(writer: BatchWriter, problems: str) -> BatchWriter:
    """A writer whose failure is noted below ``problems`` instead of ending the stream."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            writer(batch, number)
        except Exception as error:  # one failed cycle must not stop the loop
            note = [(number, type(error).__name__, str(error))]
            batch.sparkSession.createDataFrame(
                note, "batch long, error string, message string"
            ).write.mode("overwrite").json(f"{problems}/cycle={number}")

    return write


def dropped_late_rows(query: StreamingQuery, wait: float = 60.0) -> int:
    """Rows that came after the watermark had passed them, in all batches of this run so far.

    Counts queries of :func:`start` and :func:`start_table`, and those started
    after :func:`count_late_rows`. Reports reach the count a moment after their
    batch; one that is not there after ``wait`` seconds raises.
    """
    run = str(query.runId)
    late = next((x for x in _late_rows.values() if run in x.dropped), None)
    if late is None:
        raise ValueError("call count_late_rows before the query starts")
    latest = query.lastProgress
    least = latest.batchId if latest else -1

    def complete() -> bool:
        return run in late.ended or (query.isActive and late.batch.get(run, -1) >= least)

    with late.changed:
        if not late.changed.wait_for(complete, wait):
            raise TimeoutError("the reports of the last batches have not come")
        return late.dropped[run]


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(batch, dropped)`` of every micro-batch that dropped late rows, over all runs of a query.

    Counts are written when a batch's report comes; if the driver ends between a
    batch and its report, that batch's count is lost. No row where nothing was dropped.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return spark.createDataFrame([], "batch long, dropped long")
    counts = spark.read.schema("dropped long, batch long").parquet(folder)
    return counts.select("batch", "dropped")
