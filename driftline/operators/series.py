"""Time-series functions over samples and request logs.

Raw rows are first reduced to one row per (labels, step); windows then run over
that table, whose length per series is the time range divided by the step, no
matter how many raw rows there are. ``ts`` of a bucket is its end: the instant
at which a trailing window that contains the whole bucket is evaluated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from driftline.functions.scalars import join_on_keys, matches, ratio
from driftline.functions.segments import with_previous
from driftline.session import materialise

INFINITY = float("inf")


# --- buckets and trailing windows ---------------------------------------------


def bucket_end(ts: Column, step_seconds: int) -> Column:
    """End of the step that holds ``ts``; an instant on a boundary ends its step."""
    step = step_seconds * 1_000_000
    return F.timestamp_micros((F.ceil(F.unix_micros(ts) / F.lit(step)) * step).cast("long"))


def buckets(
    df: DataFrame, labels: Sequence[str], ts: str, step_seconds: int, **measures: Column
) -> DataFrame:
    """One row per (labels, step) with the given aggregates (partial before the shuffle)."""
    return df.groupBy(*labels, bucket_end(F.col(ts), step_seconds).alias("ts")).agg(
        *[c.alias(name) for name, c in measures.items()]
    )


def dense(
    df: DataFrame, labels: Sequence[str], step_seconds: int, after_seconds: int | None = None
) -> DataFrame:
    """Adds the missing steps of every series between the table's first and last step.

    With ``after_seconds`` (the longest window over the series) a series begins
    with its own first step and ends so long after its own last one, so that a
    short-lived series takes no rows in which no window can see it. Reads ``df``
    several times; give it a recorded series, not a query over raw rows.
    """
    step = F.expr(f"INTERVAL {step_seconds} SECOND")
    first, last = df.agg(F.min("ts")).scalar(), df.agg(F.max("ts")).scalar()
    if after_seconds is not None:
        first = F.col("_first")
        last = F.least(last, F.col("_last") + F.expr(f"INTERVAL {after_seconds} SECOND"))
    spans = df.groupBy(*labels).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    grid = spans.select(*labels, F.explode(F.sequence(first, last, step)).alias("ts"))
    return join_on_keys(grid, df, [*labels, "ts"], "left")


def trailing(labels: Sequence[str], window_seconds: int, step_seconds: int) -> WindowSpec:
    """Window over the steps inside the last ``window_seconds``.

    Every row reads its whole frame again; for frames of many steps use
    :func:`trailing_sums` on a dense series.
    """
    back = (window_seconds - step_seconds) * 1_000_000
    spec = W.partitionBy(*labels) if labels else W.partitionBy(F.lit(0))
    return spec.orderBy(F.unix_micros("ts")).rangeBetween(-back, 0)


def trailing_sums(
    dense_series: DataFrame, labels: Sequence[str], sums: Mapping[str, tuple[Column, int]]
) -> DataFrame:
    """Sums over the last n steps of a dense series, any n at the same cost.

    ``sums`` maps a new column to (value, number of steps). A trailing sum is
    the running total minus the running total n steps earlier, so the work is
    linear in the series no matter how long the windows are. One sort serves
    all windows.
    """
    order = W.partitionBy(*labels).orderBy("ts")
    running = {
        f"_run_{name}": F.sum(F.coalesce(value, F.lit(0))).over(order)
        for name, (value, _) in sums.items()
    }
    total = dense_series.withColumns(running)
    return total.withColumns(
        {
            name: F.col(f"_run_{name}")
            - F.coalesce(F.lag(f"_run_{name}", steps).over(order), F.lit(0))
            for name, (_, steps) in sums.items()
        }
    ).drop(*running)


def rate(count: str, labels: Sequence[str], window_seconds: int, step_seconds: int) -> Column:
    """Events per second in a trailing window over bucketed counts."""
    return F.sum(count).over(trailing(labels, window_seconds, step_seconds)) / window_seconds


def average_over_time(
    value: str, labels: Sequence[str], window_seconds: int, step_seconds: int
) -> Column:
    """Mean of the samples in a trailing window; absent samples do not count."""
    return F.avg(value).over(trailing(labels, window_seconds, step_seconds))


def record(df: DataFrame, name: str) -> DataFrame:
    """A recorded series: computed once, written, and read by all later users."""
    return materialise(df, f"record-{name}")


# --- counters -----------------------------------------------------------------


def counter_deltas(
    samples: DataFrame,
    labels: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Adds ``delta``: growth since the previous sample. After a reset the counter restarted at 0."""
    prev = F.col(f"prev_{value}")
    return with_previous(samples, labels, ts, [value], tie).withColumn(
        "delta",
        F.when(prev.isNull(), F.lit(None))
        .when(F.col(value) >= prev, F.col(value) - prev)
        .otherwise(F.col(value)),
    )


def counter_increase(
    samples: DataFrame,
    labels: Sequence[str],
    window_seconds: int,
    step_seconds: int,
    ts: str = "ts",
    value: str = "value",
    tie: Sequence[str] = (),
    extrapolate: bool = False,
) -> DataFrame:
    """``increase`` and ``rate`` of a counter in trailing windows, at every step with samples.

    By default the increase is the sum of the deltas that end in the window.
    With ``extrapolate`` only samples inside the window count, and the growth is
    stretched to its edges by at most half an average sample distance (or to
    the edge if a sample is near it), never below zero.
    """
    deltas = counter_deltas(samples, labels, ts, value, tie)
    first = F.struct(
        F.unix_micros(ts).alias("us"),
        *tie,
        F.col(value).cast("double").alias("v"),
        F.coalesce("delta", F.lit(0)).cast("double").alias("d"),
    )
    per_step = deltas.groupBy(*labels, bucket_end(F.col(ts), step_seconds).alias("ts")).agg(
        F.sum("delta").cast("double").alias("grown"),
        F.min(first).alias("first"),
        F.max(F.unix_micros(ts)).alias("last_us"),
        F.count(F.lit(1)).alias("samples"),
    )
    window = trailing(labels, window_seconds, step_seconds)
    out = per_step.select(
        *labels,
        "ts",
        F.coalesce(F.sum("grown").over(window), F.lit(0.0)).alias("increase"),
        F.min("first").over(window).alias("first"),
        F.max("last_us").over(window).alias("last_us"),
        F.sum("samples").over(window).alias("samples"),
    )
    if extrapolate:
        second = 1_000_000.0
        inside = F.col("increase") - F.col("first.d")
        spread = (F.col("last_us") - F.col("first.us")) / second
        between = spread / (F.col("samples") - 1)
        end_us = F.unix_micros("ts")
        to_start = (F.col("first.us") - (end_us - window_seconds * 1_000_000)) / second
        to_end = (end_us - F.col("last_us")) / second
        to_zero = F.when(inside > 0, spread * F.col("first.v") / inside)
        to_start = F.least(to_start, F.coalesce(to_zero, to_start))
        reach = (
            spread
            + F.when(to_start < between * 1.1, to_start).otherwise(between / 2)
            + F.when(to_end < between * 1.1, to_end).otherwise(between / 2)
        )
        out = out.filter((F.col("samples") > 1) & (spread > 0)).withColumn(
            "increase", inside * reach / spread
        )
    return out.select(*labels, "ts", "increase", (F.col("increase") / window_seconds).alias("rate"))


def changes(
    samples: DataFrame,
    labels: Sequence[str],
    window_seconds: int,
    step_seconds: int,
    ts: str = "ts",
    value: str = "value",
    tie: Sequence[str] = (),
) -> DataFrame:
    """How often the value changed in trailing windows."""
    flagged = with_previous(samples, labels, ts, [value], tie).withColumn(
        "changed", (F.col(value) != F.col(f"prev_{value}")).cast("long")
    )
    per_step = buckets(
        flagged, labels, ts, step_seconds, changed=F.coalesce(F.sum("changed"), F.lit(0))
    )
    return per_step.select(
        *labels,
        "ts",
        F.sum("changed").over(trailing(labels, window_seconds, step_seconds)).alias("changes"),
    )


# --- aggregation over labels --------------------------------------------------


def sum_by(df: DataFrame, labels: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).alias(value))


def avg_by(df: DataFrame, labels: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*labels).agg(F.avg(value).alias(value))


def max_without(df: DataFrame, dropped: Sequence[str], value: str = "value") -> DataFrame:
    """Largest value over the dropped labels."""
    kept = [c for c in df.columns if c != value and c not in dropped]
    return df.groupBy(*kept).agg(F.max(value).alias(value))


def count_where(
    df: DataFrame, labels: Sequence[str], condition: Column, name: str = "count"
) -> DataFrame:
    """Number of series that satisfy a condition."""
    return df.groupBy(*labels).agg(F.count_if(condition).alias(name))


def topk(
    df: DataFrame, k: int, value: str = "value", ts: str = "ts", tie: Sequence[str] = ()
) -> DataFrame:
    """The k largest series at every instant."""
    order = W.partitionBy(ts).orderBy(F.desc(value), *tie)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


# --- histograms ---------------------------------------------------------------


def cumulative_counts(value: Column, bounds: Sequence[float]) -> dict[str, Column]:
    """Aggregates ``le_0 .. le_n``: rows up to every bound; the last counts all rows."""
    out = {f"le_{i}": F.count_if(value <= bound) for i, bound in enumerate(bounds)}
    out[f"le_{len(bounds)}"] = F.count(value)
    return out


def histogram_quantile(q: float, bounds: Column, counts: Column) -> Column:
    """Quantile from cumulative counts, linear inside a bucket.

    ``bounds`` ends with infinity. A rank in the last bucket gives the last
    finite bound; an empty histogram gives null. The first bucket starts at 0
    unless its bound is not positive.
    """
    total = F.element_at(counts, -1)
    rank = total * F.lit(q)
    index = F.array_position(F.transform(counts, lambda c: c >= rank), F.lit(True)).cast("int")
    upper = F.get(bounds, index - 1)
    lower = F.when(
        index == 1, F.when(F.get(bounds, F.lit(0)) > 0, F.lit(0.0)).otherwise(upper)
    ).otherwise(F.get(bounds, index - 2))
    before = F.when(index == 1, F.lit(0)).otherwise(F.get(counts, index - 2))
    share = F.coalesce(
        F.try_divide(rank - before, (F.get(counts, index - 1) - before).cast("double")), F.lit(0.0)
    )
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(None))
        .when(index == F.size(counts), F.get(bounds, F.size(bounds) - 2))
        .otherwise(lower + (upper - lower) * share)
    )


def quantile_of_columns(q: float, bounds: Sequence[float], prefix: str = "le_") -> Column:
    """:func:`histogram_quantile` over the columns that :func:`cumulative_counts` names."""
    edges = F.array(*[F.lit(float(b)) for b in [*bounds, INFINITY]])
    counts = F.array(*[F.col(f"{prefix}{i}") for i in range(len(bounds) + 1)])
    return histogram_quantile(q, edges, counts)


def quantile_by(
    samples: DataFrame, labels: Sequence[str], q: float, le: str = "le", value: str = "value"
) -> DataFrame:
    """:func:`histogram_quantile` over samples in long form, one row per (labels, le)."""
    summed = samples.groupBy(*labels, F.col(le).cast("double").alias("_le")).agg(
        F.sum(value).alias("_c")
    )
    # One entry per bucket bound, a constant of the instrumented program.
    packed = summed.groupBy(*labels).agg(F.sort_array(F.collect_list(F.struct("_le", "_c"))).alias("_h"))
    return packed.select(
        *labels, histogram_quantile(q, F.col("_h._le"), F.col("_h._c")).alias("quantile")
    )


# --- vectors ------------------------------------------------------------------


def vector_op(
    left: DataFrame,
    right: DataFrame,
    labels: Sequence[str],
    op: Callable[[Column, Column], Column],
    value: str = "value",
) -> DataFrame:
    """One-to-one arithmetic between two vectors with equal labels; an absent label equals an absent one."""
    joined = join_on_keys(left, right.select(*labels, F.col(value).alias("_other")), labels)
    return joined.select(*labels, op(F.col(value), F.col("_other")).alias(value))


def divide(left: Column, right: Column) -> Column:
    return ratio(left, right)


def vector_op_ignoring(
    left: DataFrame,
    right: DataFrame,
    ignored: Sequence[str],
    op: Callable[[Column, Column], Column],
    value: str = "value",
) -> DataFrame:
    """Arithmetic on all labels but the ignored ones."""
    labels = [c for c in left.columns if c != value and c not in ignored]
    return vector_op(left, right, labels, op, value)


def group_left(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    op: Callable[[Column, Column], Column],
    value: str = "value",
) -> DataFrame:
    """Many-to-one arithmetic; labels of the left side are kept."""
    kept = [c for c in many.columns if c != value]
    side = one.select(*on, F.col(value).alias("_one"))
    return join_on_keys(many, side, on).select(*kept, op(F.col(value), F.col("_one")).alias(value))


def vector_and(left: DataFrame, right: DataFrame, labels: Sequence[str]) -> DataFrame:
    return join_on_keys(left, right.select(*labels), labels, "left_semi")


def vector_or(left: DataFrame, right: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows of the left, plus rows of the right whose labels the left lacks."""
    missing = join_on_keys(right, left.select(*labels).distinct(), labels, "left_anti")
    return left.unionByName(missing.select(*left.columns))


def or_default(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value, F.lit(default))


def matching(
    df: DataFrame,
    equal: Mapping[str, str] | None = None,
    like: Mapping[str, str] | None = None,
    unlike: Mapping[str, str] | None = None,
) -> DataFrame:
    """Label matchers; patterns match the whole value, an absent label counts as empty."""
    for label, wanted in (equal or {}).items():
        df = df.filter(F.coalesce(F.col(label), F.lit("")) == wanted)
    for label, pattern in (like or {}).items():
        df = df.filter(matches(F.col(label), pattern))
    for label, pattern in (unlike or {}).items():
        df = df.filter(~matches(F.col(label), pattern))
    return df


def days_since(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def hold(
    df: DataFrame,
    labels: Sequence[str],
    condition: Column,
    for_seconds: int,
    step_seconds: int,
    ts: str = "ts",
) -> DataFrame:
    """Instants at which the condition holds, with ``active_since`` and ``state``.

    ``pending`` until the condition has held at every step for ``for_seconds``,
    then ``firing``. A missing step breaks the run. Works on evaluation
    instants, so a series is as long as its time range has steps.
    """
    order = W.partitionBy(*labels).orderBy(F.unix_micros(ts))
    us = F.unix_micros(ts)
    step = step_seconds * 1_000_000
    previous = F.lag(us).over(order)
    return (
        df.filter(condition)
        .withColumn("_starts", F.when(previous.isNull() | (us - previous > step), F.col(ts)))
        .withColumn("active_since", F.last("_starts", ignorenulls=True).over(order))
        .withColumn(
            "state",
            F.when(
                us - F.unix_micros("active_since") >= for_seconds * 1_000_000, "firing"
            ).otherwise("pending"),
        )
        .drop("_starts")
    )
