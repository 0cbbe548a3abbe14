"""Null handling: sparse columns, median and mode imputation, row gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import DataError, EmptyDataError, InsufficientDataError
from driftline.functions.order_stats import LINEAR, exact_quantiles, unpivot

# Defaults of the cleaning step.
NULL_THRESHOLD = 0.5
MIN_ROWS = 10


def check_parameters(null_threshold: float, min_rows: int) -> None:
    if not 0.0 <= null_threshold <= 1.0:
        raise DataError(f"null_threshold must be between 0 and 1, got {null_threshold}")
    if min_rows < 1:
        raise DataError(f"min_rows must be at least 1, got {min_rows}")


def parameter_problem(null_threshold: Column, min_rows: Column) -> Column:
    """:func:`check_parameters` for a table of settings: what is wrong first; null if nothing is.

    A missing or NaN threshold and a missing number of rows are wrong, too.
    """
    inside = F.coalesce(~F.isnan(null_threshold) & null_threshold.between(0.0, 1.0), F.lit(False))
    return (
        F.when(~inside, "null_threshold must be between 0 and 1")
        .when(~F.coalesce(min_rows >= 1, F.lit(False)), "min_rows must be at least 1")
    )


def _missing(df: DataFrame, column: str) -> Column:
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    null = F.col(column).isNull()
    return null | F.isnan(column) if floating else null


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, rows, nulls, share)`` of every column in one pass; NaN counts as null."""
    counts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(_missing(df, c)).alias("nulls"),
        )
        for c in df.columns
    ]
    return (
        df.agg(F.array(*counts).alias("a"))
        .select(F.inline("a"))
        .withColumn("share", F.coalesce(F.try_divide(F.col("nulls"), F.col("rows")), F.lit(0.0)))
    )


def sparse_columns(profile: DataFrame, threshold: float = NULL_THRESHOLD) -> list[str]:
    """Columns whose null share is above the threshold (not equal to it)."""
    return [r["column"] for r in profile.filter(F.col("share") > threshold).collect()]


def drop_sparse_columns(df: DataFrame, threshold: float = NULL_THRESHOLD) -> DataFrame:
    return df.drop(*sparse_columns(null_profile(df), threshold))


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n, median)``, exact, mean of the two middle values."""
    return exact_quantiles(unpivot(df, columns), ["feature"], "value", [0.5], LINEAR).select(
        "feature", "n", F.col("q")[0].alias("median")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, mode, n)``: most frequent value as text, the smallest one on ties."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    counts = (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    return best.select("feature", F.col("b.value").alias("mode"), (-F.col("b.n")).alias("n"))


def impute(
    df: DataFrame, columns: Sequence[str] | None = None, with_nulls: Sequence[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Fills nulls: numbers with the median, everything else with the mode.

    Returns the table and the filled columns. A number column with nulls
    becomes double, since a median may fall between two values. ``with_nulls``
    names the columns that have nulls, where that is known already.
    """
    names = list(columns) if columns is not None else df.columns
    if not names:
        return df, []
    if with_nulls is None:
        profile = null_profile(df.select(*names)).filter(F.col("nulls") > 0)
        with_nulls = [r["column"] for r in profile.collect()]  # one row per column
    numeric = _numeric(df, with_nulls)
    other = [c for c in with_nulls if c not in numeric]
    fill: dict[str, Column] = {}
    if numeric:
        for row in medians(df, numeric).collect():  # one row per column
            fill[row["feature"]] = F.lit(row["median"])
    if other:
        for row in modes(df, other).collect():  # one row per column
            fill[row["feature"]] = F.lit(row["mode"]).cast(df.schema[row["feature"]].dataType)
    out = df.withColumns(
        {
            c: F.when(_missing(df, c), value).otherwise(
                F.col(c).cast("double") if c in numeric else F.col(c)
            )
            for c, value in fill.items()
        }
    )
    return out, [c for c in names if c in fill]


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop()


def min_rows_verdict(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row: ``rows``, ``min_rows`` and whether there are ``enough``."""
    counted = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("min_rows", F.lit(min_rows).cast("long"))
    return counted.withColumn("enough", F.col("rows") >= F.col("min_rows"))


def min_rows_gate(df: DataFrame, min_rows: int = MIN_ROWS) -> int:
    """Number of rows; raises if there are fewer than ``min_rows``."""
    verdict = min_rows_verdict(df, min_rows).first()
    if not verdict["enough"]:
        raise InsufficientDataError(
            f"{verdict['rows']} rows after cleaning, at least {min_rows} needed"
        )
    return verdict["rows"]


@dataclass(frozen=True)
class CleanReport:
    original_rows: int
    clean_rows: int
    null_count: int
    rows_removed: int
    columns_dropped: tuple[str, ...]
    columns_imputed: tuple[str, ...]

    def to_df(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.createDataFrame(
            [
                (
                    self.original_rows,
                    self.clean_rows,
                    self.null_count,
                    self.rows_removed,
                    list(self.columns_dropped),
                    list(self.columns_imputed),
                )
            ],
            "original_rows long, clean_rows long, null_count long, rows_removed long, "
            "columns_dropped array<string>, columns_imputed array<string>",
        )


def clean(
    df: DataFrame,
    min_rows: int = MIN_ROWS,
    null_threshold: float = NULL_THRESHOLD,
    drop_rows: bool = False,
) -> tuple[DataFrame, CleanReport]:
    """Drops sparse columns, imputes the rest, optionally drops rows still null."""
    check_parameters(null_threshold, min_rows)
    profile = null_profile(df).collect()  # one row per column
    original = profile[0]["rows"] if profile else 0
    if original == 0:
        raise EmptyDataError("the input has no rows")
    dropped = [r["column"] for r in profile if r["share"] > null_threshold]
    with_nulls = [r["column"] for r in profile if r["nulls"] > 0 and r["column"] not in dropped]
    filled, imputed = impute(df.drop(*dropped), with_nulls=with_nulls)
    removed, rows = 0, original
    if drop_rows and filled.columns:
        filled = drop_null_rows(filled)
    if drop_rows or not filled.columns:
        rows = filled.count() if filled.columns else original
        removed = original - rows
    if rows < min_rows:
        raise InsufficientDataError(f"{rows} rows after cleaning, at least {min_rows} needed")
    report = CleanReport(
        original, rows, sum(r["nulls"] for r in profile), removed, tuple(dropped), tuple(imputed)
    )
    return filled, report
