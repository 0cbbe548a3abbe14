import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftline.errors import (
    DataError,
    EmptyDataError,
    FeatureError,
    InsufficientDataError,
    MissingColumnError,
)
from driftline.operators import clean, contract, features

FLOWERS = contract.Contract(
    (
        contract.ColumnRule("sepal_length", "double", (contract.ge(0), contract.le(15))),
        contract.ColumnRule("petal_width", "double", (contract.ge(0), contract.le(10))),
        contract.ColumnRule(
            "species", "string", (contract.isin(["setosa", "versicolor", "virginica"]),)
        ),
    )
)


# --- contract -----------------------------------------------------------------


def test_valid_rows_pass(spark, flowers):
    df = spark.createDataFrame(flowers)
    assert contract.contract_failures(df, FLOWERS).count() == 0
    assert contract.structural_failures(df, FLOWERS).count() == 0


def test_all_failures_are_collected(spark):
    df = spark.createDataFrame(
        [(1, -1.0, 11.0, "rose"), (2, 16.0, None, None)],
        "id int, sepal_length double, petal_width double, species string",
    )
    found = {
        (r["id"], r["column"], r["check"], r["failure_case"])
        for r in contract.contract_failures(df, FLOWERS, ["id"]).collect()
    }
    assert found == {
        (1, "sepal_length", "ge(0)", "-1.0"),
        (1, "petal_width", "le(10)", "11.0"),
        (1, "species", "isin(setosa,versicolor,virginica)", "rose"),
        (2, "sepal_length", "le(15)", "16.0"),
    }


def test_boundaries_pass(spark):
    df = spark.createDataFrame(
        [(0.0, 10.0, "setosa"), (15.0, 0.0, "virginica")],
        "sepal_length double, petal_width double, species string",
    )
    assert contract.contract_failures(df, FLOWERS).count() == 0


def test_structure_is_enforced(spark):
    missing = spark.createDataFrame([(1.0, "setosa")], "sepal_length double, species string")
    with pytest.raises(DataError, match="petal_width"):
        contract.enforce(missing, FLOWERS)
    text = spark.createDataFrame(
        [("x", "1", "setosa")], "sepal_length string, petal_width string, species string"
    )
    with pytest.raises(DataError, match="dtype"):
        contract.enforce(text, FLOWERS)
    with pytest.raises(EmptyDataError):
        contract.enforce(missing.limit(0), FLOWERS)


def test_text_numbers_are_coerced(spark):
    df = spark.createDataFrame(
        [("5.1", "0.2", "setosa", 7)], "sepal_length string, petal_width string, species string, more int"
    )
    out = contract.enforce(df, FLOWERS)
    assert out.schema["sepal_length"].dataType.simpleString() == "double"
    assert out.first()["sepal_length"] == 5.1 and "more" in out.columns


def test_not_nullable(spark):
    rule = contract.Contract((contract.ColumnRule("a", "int", (), nullable=False),))
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert contract.contract_summary(df, rule).first()["failures"] == 1


# --- cleaning -----------------------------------------------------------------


def test_median_and_mode(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "b"), (2, 2.0, "a"), (None, None, None), (4, 10.0, "b"), (5, 4.0, "a")],
        "i int, d double, s string",
    )
    out, report = clean.clean(df, min_rows=1)
    got = [tuple(r) for r in out.collect()]
    assert got[2] == (3.0, 3.0, "a")  # mean of the middle two; smallest of the modes
    assert report.columns_imputed == ("i", "d", "s") and report.null_count == 3
    assert report.clean_rows == 5 and report.rows_removed == 0


def test_sparse_column_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, None)], "a int, half int, empty int")
    assert clean.drop_sparse_columns(df, 0.5).columns == ["a", "half"]


def test_all_null_table_fails(spark):
    df = spark.createDataFrame([(None, None)] * 3, "a double, b string")
    with pytest.raises(InsufficientDataError):
        clean.clean(df, min_rows=4)


def test_rows_still_null_can_be_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    kept, imputed = clean.impute(df)
    assert imputed == [] and clean.drop_null_rows(kept).count() == 0


def test_gates_and_parameters(spark):
    df = spark.range(5)
    assert clean.min_rows_gate(df, 5) == 5
    with pytest.raises(InsufficientDataError):
        clean.min_rows_gate(df, 6)
    with pytest.raises(DataError):
        clean.clean(df, null_threshold=1.5)
    with pytest.raises(DataError):
        clean.clean(df, min_rows=0)
    with pytest.raises(EmptyDataError):
        clean.clean(df.limit(0))


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert clean.null_profile(df).first()["nulls"] == 1
    assert sorted(r[0] for r in clean.impute(df)[0].collect()) == [1.0, 2.0, 3.0]


# --- features -----------------------------------------------------------------


def test_flower_features_shape(spark, flowers):
    df = spark.createDataFrame(flowers)
    out, state = features.build_features(df, "species", "id")
    assert out.count() == 150 and len(out.columns) == 6
    assert out.columns[0] == "scaler__sepal_length" and out.columns[-2:] == ["species", "is_train"]
    train = out.filter("is_train = 1")
    assert train.count() == 120
    stats = train.agg(F.avg("scaler__sepal_length"), F.stddev_pop("scaler__sepal_length")).first()
    assert abs(stats[0]) < 1e-9 and abs(stats[1] - 1) < 1e-9
    assert {r[0]: r[1] for r in train.groupBy("species").count().collect()} == {
        "setosa": 40, "versicolor": 40, "virginica": 40,
    }


def test_split_does_not_depend_on_partitioning(spark, flowers):
    df = spark.createDataFrame(flowers)
    a = {r["id"] for r in features.stratified_split(df, "species", "id").filter("is_train = 0").collect()}
    b = {
        r["id"]
        for r in features.stratified_split(df.repartition(7), "species", "id").filter("is_train = 0").collect()
    }
    c = {
        r["id"]
        for r in features.stratified_split(df, "species", "id", seed=1).filter("is_train = 0").collect()
    }
    assert a == b and len(a) == 30 and a != c


def test_split_falls_back_without_enough_rows_per_class(spark):
    df = spark.range(20).withColumn("y", F.col("id").cast("double"))
    out = features.stratified_split(df, "y", "id")
    assert out.filter("is_train = 0").count() == 4


def test_null_class_is_a_class(spark):
    df = spark.range(40).withColumn("y", F.when(F.col("id") % 2 == 0, "a"))
    out = features.stratified_split(df, "y", "id").filter("is_train = 0").groupBy("y").count()
    assert {r[0]: r[1] for r in out.collect()} == {"a": 4, None: 4}


def test_state_comes_from_train_rows_only(spark):
    df = spark.createDataFrame(
        [(1.0, "a", 1), (3.0, "b", 1), (99.0, "c", 0)], "x double, c string, is_train int"
    ).withColumn("y", F.lit(0))
    state = features.fit(df, "y")
    assert state.scale["x"] == (2.0, 1.0) and state.categories["c"] == ["a", "b"]
    out = features.transform(df, state, ["is_train"]).collect()
    assert [r["encoder__c_b"] for r in out] == [0.0, 1.0, 0.0]  # unknown category: zeros
    assert out[2]["scaler__x"] == 97.0


def test_constant_and_null_values(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, "u"), (5.0, "v")], "x double, c string").withColumn(
        "y", F.lit(0)
    )
    state = features.fit(df, "y")
    out = features.transform(df, state)
    assert [r["scaler__x"] for r in out.collect()] == [0.0, 0.0, 0.0]
    assert out.columns == ["scaler__x", "encoder__c_u", "encoder__c_v", "encoder__c_nan"]
    assert [r["encoder__c_nan"] for r in out.collect()] == [1.0, 0.0, 0.0]
    kept = features.transform(
        spark.createDataFrame([(None, "u")], "x double, c string"), state
    ).first()
    assert kept["scaler__x"] is None


def test_cardinality(spark):
    df = spark.range(6000).select(
        F.col("id").cast("string").alias("key"),
        (F.col("id") % 10).cast("string").alias("ten"),
        (F.col("id") % 11).cast("string").alias("eleven"),
        F.lit(None).cast("string").alias("nothing"),
    )
    found = {r["column"]: (r["n_unique"], r["kept"]) for r in features.cardinality_filter(df, df.columns).collect()}
    assert found == {"key": (6000, False), "ten": (10, True), "eleven": (11, False), "nothing": (0, True)}


def test_no_feature_left(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("y"))
    with pytest.raises(FeatureError):
        features.fit(df, "y")
    with pytest.raises(MissingColumnError):
        features.fit(df, "nope")


def test_state_round_trip(spark, flowers, tmp_path):
    state = features.fit(spark.createDataFrame(flowers).drop("id"), "species")
    state.to_df(spark).write.parquet(str(tmp_path / "s"))
    assert features.FeatureState.from_df(spark.read.parquet(str(tmp_path / "s"))) == state


def test_passthrough(spark):
    df = spark.createDataFrame([(True, 1)], "flag boolean, y int")
    assert features.transform(df, features.fit(df, "y")) is df


def test_alignment(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, a int, c int")
    assert features.align_named(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(MissingColumnError):
        features.align_named(df, ["z"])
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "v array<double>")
    assert features.misaligned_rows(rows, "v", 2).count() == 1
    with pytest.raises(Exception, match="expected 2 features, got 1"):
        features.align_positional(rows, "v", ["x", "y"]).collect()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=10, max_size=30))
def test_row_count_and_target_stay(spark, values):
    df = spark.createDataFrame(
        [(i, v, i % 2) for i, v in enumerate(values)], "id int, x double, y int"
    )
    out, _ = features.build_features(df, "y", "id", keep=["id"])
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        assert got[i]["y"] == i % 2 and (got[i]["scaler__x"] is None) == (v is None)
        assert got[i]["scaler__x"] is None or math.isfinite(got[i]["scaler__x"])
