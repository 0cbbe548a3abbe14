"""Checks and rewrites of rows as they come in: addresses, labels, step cache, versions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.errors import InvalidUrlError
from driftline.functions.scalars import matches
from driftline.session import materialise

# Accepted address schemes, and the age limit of cached steps.
SCHEMES = ("http", "https")
CACHE_HOURS = 24

INVALID_FORMAT = "invalid format"
UNSUPPORTED_SCHEME = "unsupported scheme"


# --- addresses ----------------------------------------------------------------


def url_problem(url: Column) -> Column:
    """Why an address is not acceptable; null for a good one."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    place = F.regexp_extract(
        F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1
    )
    return (
        F.when((scheme == "") | (place == ""), INVALID_FORMAT)
        .when(~scheme.isin(*SCHEMES), UNSUPPORTED_SCHEME)
    )


def check_urls(df: DataFrame, url: str) -> DataFrame:
    """Adds ``valid`` and ``reason``."""
    problem = url_problem(F.col(url))
    return df.withColumns({"valid": problem.isNull(), "reason": problem})


def valid_source_urls(df: DataFrame, url: str, strict: bool = False) -> DataFrame:
    """Rows with an acceptable address; with ``strict`` a bad one is an error."""
    if strict:
        bad = df.filter(url_problem(F.col(url)).isNotNull()).select(url).first()
        if bad:
            raise InvalidUrlError(f"address not accepted: {bad[0]}")
    return df.filter(url_problem(F.col(url)).isNull())


# --- step cache ---------------------------------------------------------------


def step_key(*parts: Column) -> Column:
    """Cache key of a step: SHA-256 over everything its output depends on."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def reusable_steps(
    steps: DataFrame, manifest: DataFrame, as_of: Column, hours: float = CACHE_HOURS
) -> DataFrame:
    """Adds ``output`` and ``reuse``: a kept output with the same key, young enough.

    ``manifest`` has key, output, created_at; the newest entry per key counts.
    """
    newest = manifest.groupBy("key").agg(
        F.max("created_at").alias("created_at"), F.max_by("output", "created_at").alias("output")
    )
    age = F.unix_micros(as_of) - F.unix_micros("created_at")
    fresh = (age >= 0) & (age <= int(hours * 3_600_000_000))
    return (
        steps.join(newest, "key", "left")
        .withColumn("reuse", F.coalesce(fresh, F.lit(False)))
        .withColumn("output", F.when(F.col("reuse"), F.col("output")))
        .drop("created_at")
    )


# --- dataset versions ---------------------------------------------------------


def row_digest(df: DataFrame) -> Column:
    """SHA-256 (hex) of a row: its columns by name, each as length and text, a null as ``-``.

    Instants count as microseconds and a negative zero as zero, so that any engine
    can compute the same digest.
    """

    def text(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            value = F.unix_micros(value)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0)
        elif isinstance(field.dataType, T.BinaryType):
            value = F.hex(value)
        shown = value.cast("string")
        return F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.sha2(F.concat(F.lit(""), *[text(f) for f in fields]), 256)


def _slice(digest: Column, start: int) -> Column:
    """60 bits of a hex digest."""
    return F.conv(F.substr(digest, F.lit(start), F.lit(15)), 16, 10).cast("long")


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the table's rows in any order, repeats and nulls included.

    Row count, the exclusive or of the digests' first 60 bits and the exact sum
    (as text) of their next 60.
    """
    rows = df.select(row_digest(df).alias("d"))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(_slice(F.col("d"), 1)), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(_slice(F.col("d"), 16).cast("decimal(28,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )


def dataset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with different multiplicity: ``change`` (added/removed), ``copies``, columns.

    Only digests are shuffled for all rows. Full rows follow for the digests whose
    counts differ; these are written, so that Spark knows their size when it
    chooses how to join them.
    """
    columns = old.columns
    both = old.select(*columns, F.lit(-1).alias("_n")).unionAll(
        new.select(*columns, F.lit(1).alias("_n"))
    )
    marked = both.withColumn("_d", row_digest(both.drop("_n")))
    differing = materialise(
        marked.groupBy("_d").agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0).select("_d"), "diff"
    )
    net = (
        marked.join(differing, "_d", "left_semi")
        .groupBy(*columns)
        .agg(F.sum("_n").alias("_n"))
        .filter(F.col("_n") != 0)
    )
    return net.select(
        F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"),
        F.abs("_n").alias("copies"),
        *columns,
    )


# --- labels and events --------------------------------------------------------


def json_event_filter(df: DataFrame, body: str, path: str, value: str) -> DataFrame:
    """Events whose JSON body has the value at the path."""
    return df.filter(F.get_json_object(body, path) == value)


@dataclass(frozen=True)
class Rule:
    """A label rule: keep or drop rows, or write a target label.

    ``sources`` are joined by ``;`` and matched whole against ``regex``; the
    replacement may use $1, $2 ...
    """

    sources: tuple[str, ...]
    regex: str = "(.*)"
    action: str = "replace"
    target: str = ""
    replacement: str = "$1"


def relabel(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Applies label rules in order. A rule that does not match leaves its target alone."""
    for rule in rules:
        joined = F.concat_ws(
            ";", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in rule.sources]
        )
        hit = matches(joined, rule.regex)
        if rule.action == "keep":
            df = df.filter(hit)
        elif rule.action == "drop":
            df = df.filter(~hit)
        else:
            written = F.regexp_replace(joined, f"^(?:{rule.regex})$", rule.replacement)
            old = F.col(rule.target) if rule.target in df.columns else F.lit(None).cast("string")
            df = df.withColumn(rule.target, F.when(hit, written).otherwise(old))
    return df
