"""CSV rows over several lines, read split by split."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from driftline.sources import files, quoted

SCHEMA = "a long, b string, c string"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written(path, rows, end="\n", all_quoted=False):
    kind = csv.QUOTE_ALL if all_quoted else csv.QUOTE_MINIMAL
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=kind).writerows([("a", "b", "c"), *rows])
    path.write_bytes(out.getvalue().encode())
    return str(path)


def some_rows(seed, n, long=False):
    rng = random.Random(seed)
    parts = ["x", "yz", '"', '""', ",", "\n", "\n\n", " ", "é", '",\n"', "w" * 40]
    rows = []
    for i in range(n):
        b, c = ("k" + "".join(rng.choices(parts, k=rng.randrange(9))) + "k" for _ in range(2))
        if long and i % 37 == 5:
            b = "k" + "long\n" * 2000 + "k"  # over several splits
        rows.append((i, b, c))
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("all_quoted", [False, True])
def test_one_file_read_by_many_tasks(spark, tmp_path, small_splits, end, all_quoted):
    rows = some_rows(1, 160, long=True)
    path = written(tmp_path / "t.csv", rows, end, all_quoted)
    assert quoted.lines_of(spark, path).rdd.getNumPartitions() > 10
    for strict in (True, False):
        df = files.read_csv_table(spark, path, SCHEMA, strict=strict)
        got = df.orderBy("a").select("a", "b", "c").collect()
        assert [tuple(r) for r in got] == rows
    assert files.malformed_rows(df).count() == 0


def test_files_of_a_folder_keep_their_own_state(spark, tmp_path, small_splits):
    folder = tmp_path / "t"
    folder.mkdir()
    rows = some_rows(2, 120)
    for i in range(6):
        written(folder / f"{i}.csv", rows[i * 20 : i * 20 + 20])
    (folder / "open.csv").write_text('a,b,c\n500,x,"never closed\nmore\n')
    df = files.read_csv_table(spark, str(folder), SCHEMA, strict=False)
    got = {r["a"]: (r["b"], r["c"]) for r in df.filter("a < 500").collect()}
    assert got == {a: (b, c) for a, b, c in rows}
    assert df.filter("a >= 500").count() == 1


def test_a_quote_inside_a_cell_without_quotes_opens_nothing(spark, tmp_path, small_splits):
    body = "".join(f'{i},5" pipe,"in\nside {i}"\n\n' for i in range(200))
    (tmp_path / "t.csv").write_text("a,b,c\n" + body)
    df = files.read_csv_table(spark, str(tmp_path / "t.csv"), SCHEMA)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(i, '5" pipe', f"in\nside {i}") for i in range(200)]


def test_a_header_over_lines_and_splits(spark, tmp_path, small_splits):
    header = 'a,"b\n' + "name\n" * 900 + '",c\n'
    (tmp_path / "t.csv").write_text(header + '1,"x\ny",z\n')
    df = files.read_csv_table(spark, str(tmp_path / "t.csv"), SCHEMA)
    assert [tuple(r) for r in df.collect()] == [(1, "x\ny", "z")]


def test_malformed_rows_between_rows_over_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,"x\ny",z\n2,x\nq,x,"\n"\n')
    path = str(tmp_path / "t.csv")
    df = files.read_csv_table(spark, path, SCHEMA, strict=False)
    assert df.count() == 3 and files.malformed_rows(df).count() == 1
    for ask in (lambda d: d.select("a").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="(?i)malformed"):
            ask(files.read_csv_table(spark, path, SCHEMA, check_empty=False))


def test_plain_files_stay_with_the_built_in_reader(spark, tmp_path):
    path = written(tmp_path / "t.csv", [(1, "x", 'say "y"'), (2, "", "z,")], "\r\n")
    df = files.read_csv_table(spark, path, SCHEMA)
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x", 'say "y"'), (2, None, "z,")]


def test_other_carriage_returns(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'a,b,c\n1,"x\ry",z\n2,"p\nq",r\n')
    df = files.read_csv_table(spark, str(tmp_path / "t.csv"), SCHEMA)
    assert [r["b"] for r in df.orderBy("a").collect()] == ["x\ry", "p\nq"]


def test_other_splits_than_looked_up_are_refused(spark, tmp_path, small_splits):
    path = written(tmp_path / "t.csv", some_rows(3, 100))
    df = files.read_csv_table(spark, path, SCHEMA)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    with pytest.raises(Exception, match="splits of the files changed"):
        df.select("a").collect()


def test_state_of_a_line(spark):
    cases = {'a,"b': (True, False), '"a",b': (False, False), "a": (False, True), 'a","b': (True, True),
             'a,"b""': (True, False), '"""a"""': (False, False), 'x"y': (False, False), '","': (False, True)}
    df = spark.createDataFrame([(k,) for k in cases], "value string")
    state = [quoted._state_after(F.col("value"), s) for s in (False, True)]
    assert {r[0]: (r[1], r[2]) for r in df.select("value", *state).collect()} == cases
