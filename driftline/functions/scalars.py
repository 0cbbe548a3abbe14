"""Small Column helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_double(col: Column | str) -> Column:
    """The value as a double, with NaN turned into null."""
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(value), value)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, null where the denominator is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def known_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of some columns that tells (x, null) from (null, x)."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def floor_at(value: Column, minimum: float) -> Column:
    """The value, but at least ``minimum``."""
    return F.greatest(value, F.lit(minimum))


def equal_width_bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """0-based equal-width bucket over [low, high]; the maximum falls in the last one."""
    position = F.try_divide((value - low) * F.lit(float(buckets)), high - low)
    return F.least(F.floor(position), F.lit(buckets - 1)).cast("int")


def matches(col: Column, pattern: str) -> Column:
    """Regular-expression match of the whole string."""
    return F.coalesce(col, F.lit("")).rlike(f"^(?:{pattern})$")


def band(value: Column, steps: Sequence[tuple[float, str]], base: str = "green") -> Column:
    """Name of the highest threshold that ``value`` reaches; ``base`` below all."""
    result = F.lit(base)
    for threshold, name in sorted(steps):
        result = F.when(value >= threshold, F.lit(name)).otherwise(result)
    return F.when(value.isNotNull(), result)


def stable_hash(key: Column, seed: int) -> Column:
    """A non-negative 60-bit hash of a key, equal on every engine that has SHA-256."""
    digest = F.sha2(F.concat_ws("|", key.cast("string"), F.lit(str(seed))), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def align_down(ts: Column, step_seconds: int) -> Column:
    """Start of the step that holds ``ts``, as a timestamp."""
    step = step_seconds * 1_000_000
    return from_micros((F.floor(F.unix_micros(ts) / F.lit(step)) * F.lit(step)).cast("long"))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """As ``left.join(right, keys, how)``, but a null key equals a null key; the keys are the left ones.

    Without keys every row meets every row, as in a join of two series without labels.
    """
    if not keys:
        return left.join(right, F.lit(True), how)
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(and_, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
