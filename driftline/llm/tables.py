"""What the operators share: the documents as they come, written tables, components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import materialise

#: Removes a query's shuffle files when it has ended instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Sets a session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows handed to Python at once; whole documents are long rows, and executors hold several batches.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
#: Bytes handed to Python at once, about, for operators that hold several columns of a batch's size.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


@contextmanager
def small_batches(spark: SparkSession):
    """Python gets few rows and few bytes at once from what runs meanwhile."""
    key, rows = BATCH_ROWS
    fewer = str(min(rows, int(spark.conf.get(key, "10000")) or rows))
    with setting(spark, key, fewer), setting(spark, *BATCH_BYTES):
        yield


def write(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder, rereads it and drops its shuffle files."""
    spark = df.sparkSession
    key, rows = BATCH_ROWS
    fewer = str(min(rows, int(spark.conf.get(key, "10000")) or rows))
    with setting(spark, CLEANUP, "true"), setting(spark, key, fewer):
        table = materialise(df, label)
    for made in _made:
        made.append(table)
    return table


_made: list[list[DataFrame]] = []


@contextmanager
def recorded():
    """Lists the tables that :func:`write` makes meanwhile."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)


def discard(tables) -> None:
    """Deletes written tables that no plan reads any more."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each round every node is put under the smallest of itself and its neighbours
    (a hub's many edges are summed before the shuffle), the labels are followed
    to their roots by pointer jumping, and the edges are contracted to those
    between different roots. So an edge is joined with labels once in most
    cases, and rounds grow with the logarithm of a component's width.
    """
    near, far = F.least(a, b), F.greatest(a, b)
    left = write(edges.select(near.alias("a"), far.alias("b")).filter("a <> b").distinct(), "links")
    groups = None
    while True:
        sides = F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
        )
        ends = left.select(F.inline(sides))
        labels = write(
            ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels"
        )
        labels = _to_roots(labels)
        if groups is None:
            groups = labels
        else:
            roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
            groups = groups.join(roots, "component", "left")
            groups = write(groups.select("node", F.coalesce("root", "component").alias("component")), "groups")
        under = [
            labels.select(F.col("node").alias(c), F.col("component").alias(f"under_{c}")) for c in ("a", "b")
        ]
        moved = left.join(under[0], "a").join(under[1], "b").filter("under_a <> under_b")
        moved = moved.select(F.least("under_a", "under_b").alias("a"), F.greatest("under_a", "under_b").alias("b"))
        left = write(moved.distinct(), "links")
        if left.isEmpty():
            return groups


def _to_roots(labels: DataFrame) -> DataFrame:
    """Labels (never above their node) replaced by their own labels until nothing changes."""
    while True:
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = write(labels.join(further, "component").select("node", "component", "further"), "labels")
        labels = after.select("node", F.col("further").alias("component"))
        if after.filter("component <> further").isEmpty():
            return labels


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """The ``rows`` rows whose keys have the smallest hashes, ``total`` being about all there are.

    A share of the hashes that holds some four times as many rows is cut off
    first, so that what is sorted stays as small as the sample.
    """
    share = min(1.0, (4 * rows + 100) / max(total, 1))
    hashed = F.xxhash64(key)
    near = df if share >= 1 else df.filter(F.pmod(hashed, F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    return near.orderBy(hashed, key).limit(rows)
