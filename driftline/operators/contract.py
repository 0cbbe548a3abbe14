"""Declared table contracts: types, ranges, allowed values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.errors import DataError, EmptyDataError


@dataclass(frozen=True)
class Check:
    """A named test; ``passes`` maps the column to a boolean. Nulls are not tested."""

    name: str
    passes: Callable[[Column], Column]
    message: str = ""


def ge(bound: float, message: str = "") -> Check:
    return Check(f"ge({bound})", lambda c: c >= F.lit(bound), message)


def le(bound: float, message: str = "") -> Check:
    return Check(f"le({bound})", lambda c: c <= F.lit(bound), message)


def isin(values: Sequence, message: str = "") -> Check:
    return Check(f"isin({','.join(map(str, values))})", lambda c: c.isin(list(values)), message)


@dataclass(frozen=True)
class ColumnRule:
    name: str
    dtype: str
    checks: tuple[Check, ...] = ()
    nullable: bool = True


@dataclass(frozen=True)
class Contract:
    """Rules for named columns; columns without a rule are allowed."""

    columns: tuple[ColumnRule, ...] = field(default_factory=tuple)


def _present(df: DataFrame, contract: Contract) -> list[ColumnRule]:
    return [rule for rule in contract.columns if rule.name in df.columns]


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Casts declared columns to their types; a value that cannot be cast becomes null."""
    return df.withColumns(
        {rule.name: F.col(rule.name).try_cast(rule.dtype) for rule in _present(df, contract)}
    )


def _tests(rules: Sequence[ColumnRule]) -> list[tuple[str, Check, Column]]:
    """(column, check, failed) for every check of every rule."""
    out = []
    for rule in rules:
        value = F.col(rule.name).try_cast(rule.dtype)
        if not rule.nullable:
            out.append((rule.name, Check("not_nullable", lambda c: c), value.isNull()))
        for check in rule.checks:
            out.append((rule.name, check, value.isNotNull() & ~check.passes(value)))
    return out


def structural_failures(df: DataFrame, contract: Contract) -> DataFrame:
    """``(column, check, failures)`` for missing columns and values of the wrong type.

    These are errors of the producer; cleaning cannot mend them.
    """
    spark = df.sparkSession
    missing = [r.name for r in contract.columns if r.name not in df.columns]
    out = spark.createDataFrame(
        [(c, "column_in_dataframe", None) for c in missing],
        "column string, check string, failures long",
    )
    present = _present(df, contract)
    if not present:
        return out
    counts = [
        F.struct(
            F.lit(r.name).alias("column"),
            F.lit(f"dtype({r.dtype})").alias("check"),
            F.count_if(
                F.col(r.name).isNotNull() & F.col(r.name).try_cast(r.dtype).isNull()
            ).alias("failures"),
        )
        for r in present
    ]
    bad = df.agg(F.array(*counts).alias("a")).select(F.inline("a")).filter("failures > 0")
    return out.unionAll(bad)


def contract_failures(df: DataFrame, contract: Contract, keys: Sequence[str] = ()) -> DataFrame:
    """One row per failed value check: keys, column, check, failing value. No shuffle."""
    tests = _tests(_present(df, contract))
    if not tests:
        raise DataError("the contract has no check for any column of the table")
    cases = F.array(
        *[
            F.struct(
                F.lit(column).alias("column"),
                F.lit(check.name).alias("check"),
                F.col(column).cast("string").alias("failure_case"),
                F.coalesce(failed, F.lit(False)).alias("failed"),
            )
            for column, check, failed in tests
        ]
    )
    return df.select(*keys, F.inline(F.filter(cases, lambda x: x["failed"]))).drop("failed")


def contract_summary(df: DataFrame, contract: Contract) -> DataFrame:
    """``(column, check, failures, rows)``: all checks counted in one pass."""
    tests = _tests(_present(df, contract))
    counts = [
        F.struct(
            F.lit(column).alias("column"),
            F.lit(check.name).alias("check"),
            F.lit(check.message).alias("message"),
            F.count_if(failed).alias("failures"),
            F.count(F.lit(1)).alias("rows"),
        )
        for column, check, failed in tests
    ]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """The coerced table; raises if it is empty or structurally wrong."""
    if df.isEmpty():
        raise EmptyDataError("the input has no rows")
    found = structural_failures(df, contract).collect()  # at most one row per rule
    if found:
        names = ", ".join(f"{r['column']}: {r['check']}" for r in found)
        raise DataError(f"{len(found)} structural contract failures ({names})")
    return coerce(df, contract)
