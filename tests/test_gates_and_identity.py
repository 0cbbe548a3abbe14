"""Verdict rows of gates, row digests, encodings of split files, late rows over restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.errors import DataError
from driftline.operators import clean, model
from driftline.sources import files, intake
from driftline.sources.files import stream_source
from driftline.streaming import tables

T0 = datetime(2024, 1, 1)


def test_parameter_problem_agrees_with_the_raising_form(spark):
    settings = [(0.0, 1), (1.0, 5), (-0.1, 1), (1.1, 1), (0.5, 0), (None, 1), (0.5, None), (float("nan"), 1)]
    df = spark.createDataFrame(settings, "t double, n long")
    found = [r[0] for r in df.select(clean.parameter_problem(F.col("t"), F.col("n"))).collect()]
    assert [x is None for x in found] == [True, True] + [False] * 6
    for (t, n), problem in zip(settings[:5], found):
        if problem is None:
            clean.check_parameters(t, n)
        else:
            with pytest.raises(DataError, match=problem[:20]):
                clean.check_parameters(t, n)


def test_min_rows_verdict(spark):
    assert tuple(clean.min_rows_verdict(spark.range(5), 5).first()) == (5, 5, True)
    assert tuple(clean.min_rows_verdict(spark.range(0)).first()) == (0, clean.MIN_ROWS, False)


def test_steps_around_a_model(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0)], "k long, x double")

    def roots(frame):
        if (frame["y"] < 0).any():
            raise ValueError("negative")
        return frame["y"] ** 0.5

    out = model.predict_between(
        df,
        roots,
        ["y"],
        lambda d: d.withColumn("y", F.col("x") * 2),
        lambda d: d.select("k", F.coalesce("prediction", F.lit(-1.0)), "error"),
    )
    assert sorted(map(tuple, out.collect())) == [(1, 2.0, None), (2, -1.0, "ValueError: negative")]
    assert model.predict_between(df, lambda f: f["x"], ["x"]).columns == ["k", "x", "prediction", "error"]


def test_digest_tells_columns_nulls_and_copies_apart(spark):
    schema = "a string, b string"
    tables_ = [[("1", "2")], [("12", "")], [("", "12")], [(None, "x")], [("x", None)], [("-", "x")], [("1", "2")] * 2, []]
    found = {tuple(intake.dataset_fingerprint(spark.createDataFrame(t, schema)).first()) for t in tables_}
    assert len(found) == len(tables_)
    zero = spark.createDataFrame([(0.0,)], "x double")
    assert intake.dataset_fingerprint(zero).first() == intake.dataset_fingerprint(zero.select((-F.col("x")).alias("x"))).first()


def test_diff_with_nulls_and_equal_tables(spark):
    schema = "a string, b long"
    old = spark.createDataFrame([(None, 1), ("x", None), ("y", 2)], schema)
    new = spark.createDataFrame([(None, 1), (None, 1), ("y", 2), (None, None)], schema)
    found = {tuple(r) for r in intake.dataset_diff(old, new).collect()}
    assert found == {("added", 1, None, 1), ("removed", 1, "x", None), ("added", 1, None, None)}
    assert intake.dataset_diff(old, old).count() == 0


def test_encoding_of_a_file_in_many_splits(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "x").mkdir(parents=True)
    line = "grün und blau\r\n"
    (folder / "x" / "utf8.txt").write_bytes(line.encode() * 4000)
    (folder / "x" / "late.txt").write_bytes(b"plain\n" * 9000 + line.encode("cp1252"))
    (folder / "iso.txt").write_bytes(b"plain\n" * 9000 + b"\x81\xfc")
    (folder / "cut.txt").write_bytes(b"ok\n\xc3\n\xbc\n")
    (folder / "empty.txt").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(str(folder))
        assert lines.rdd.getNumPartitions() > 5
        found = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in files.detect_encoding(spark, str(folder)).collect()}
        whole = {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in files.detect_encoding(spark, str(folder), True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {"utf8.txt": "utf-8", "late.txt": "cp1252", "iso.txt": "iso-8859-1", "cut.txt": "cp1252", "empty.txt": "utf-8"}
    assert found == want
    assert whole["x"] == "cp1252" and whole["in"] == "iso-8859-1"


def test_late_rows_are_counted_over_restarts(spark, tmp_path):
    path, schema = str(tmp_path), "ts timestamp, id long"
    assert tables.late_rows(spark, f"{path}/late").count() == 0
    steps = [[(T0 + timedelta(days=3), 0)], [(T0, 1), (T0, 2)], [(T0 + timedelta(days=4), 3)], [(T0, 4)]]
    for step in steps:
        spark.createDataFrame(step, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = stream_source(spark, f"{path}/in", schema)
        fresh = source.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["id"])
        query = tables.start_table(fresh, f"{path}/t", f"{path}/c", late=f"{path}/late")
        tables.dropped_late_rows(tables.drain(query))
    counts = tables.late_rows(spark, f"{path}/late")
    assert sorted(r["dropped"] for r in counts.collect()) == [1, 2]
    assert spark.read.parquet(f"{path}/t").count() == 2
