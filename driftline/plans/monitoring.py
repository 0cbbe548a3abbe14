"""Series, SLO, alert and canary queries over events as a request log.

Service = user modulo 4, bad = event type "error", latency = value in
milliseconds. The given events are sparse, so steps are minutes to hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import alerts, canary, series, slo
from driftline.plans.registry import at_edge, query, table

HOUR, DAY = 3600, 86_400
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
BOUND_SQL = ", ".join(f"({b})" for b in BOUNDS)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.concat(F.lit("svc_"), (F.col("user_id") % 4).cast("string")).alias("service"),
        F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"),
        (F.col("user_id") % 10 == 0).alias("canary"),
    )


REQ = """req AS (
  SELECT event_id, ts, user_id, event_type, value, 'svc_' || (user_id % 4) AS service,
    CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, user_id % 10 = 0 AS canary
  FROM events)"""


def be(step: int, ts: str = "ts") -> str:
    us = step * 1_000_000
    return f"make_timestamp(CAST(ceil(epoch_us({ts}) / {us}.0) AS BIGINT) * {us})"


def over(window: int, step: int, by: str = "service") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"({part}ORDER BY ts RANGE BETWEEN INTERVAL {window - step} SECONDS PRECEDING AND CURRENT ROW)"


def quantile_sql(q: float, source: str, keys: str, value: str = "value") -> str:
    """SQL: bucket-interpolated quantile per key of a relation."""
    return f"""(
  WITH bounds(le, pos) AS (SELECT * FROM (VALUES {', '.join(f'({b}, {i})' for i, b in enumerate(BOUNDS))}, ('Infinity'::DOUBLE, {len(BOUNDS)})) v),
  c AS (SELECT {keys}, pos, le, count(*) FILTER ({value} <= le) AS c FROM {source}, bounds GROUP BY {keys}, pos, le),
  w AS (SELECT *, max(c) OVER (PARTITION BY {keys}) AS total,
      coalesce(lag(c) OVER (PARTITION BY {keys} ORDER BY pos), 0) AS prev,
      coalesce(lag(le) OVER (PARTITION BY {keys} ORDER BY pos), 0) AS lower FROM c)
  SELECT {keys}, CASE WHEN min_by(pos, pos) = {len(BOUNDS)} THEN {BOUNDS[-1]}
     ELSE min_by(lower, pos) + (min_by(le, pos) - min_by(lower, pos))
       * (({q} * any_value(total)) - min_by(prev, pos)) / (min_by(c, pos) - min_by(prev, pos)) END AS quantile
  FROM w WHERE c >= {q} * total AND total > 0 GROUP BY {keys})"""


# --- G: series ----------------------------------------------------------------


@query(
    "request_rate",
    f"""WITH {REQ}, b AS (SELECT service, {be(HOUR)} AS ts, count(*) AS n FROM req GROUP BY 1, 2)
    SELECT service, ts, round(sum(n) OVER {over(6 * HOUR, HOUR)} / {6.0 * HOUR}, 9) AS rate FROM b""",
)
def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    counted = series.buckets(requests(spark, sf), ["service"], "ts", HOUR, n=F.count(F.lit(1)))
    return at_edge(
        counted.select("service", "ts", series.rate("n", ["service"], 6 * HOUR, HOUR).alias("rate")), 9
    )


_COUNTER = """smp AS (SELECT event_type, ts, event_id, event_id % 500 AS v FROM events),
d AS (SELECT *, lag(v) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM smp),
dd AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN v >= p THEN v - p ELSE v END AS delta FROM d)"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_type", "ts", "event_id", (F.col("event_id") % 500).alias("value")
    )


@query(
    "counter_increase",
    f"""WITH {_COUNTER},
    b AS (SELECT event_type, {be(HOUR)} AS ts, sum(delta) AS g FROM dd GROUP BY 1, 2)
    SELECT event_type, ts, coalesce(sum(g) OVER w, 0)::DOUBLE AS increase,
      round(coalesce(sum(g) OVER w, 0) / {6.0 * HOUR}, 9) AS rate
    FROM b WINDOW w AS {over(6 * HOUR, HOUR, 'event_type')}""",
)
def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(
        series.counter_increase(
            _samples(spark, sf), ["event_type"], 6 * HOUR, HOUR, tie=["event_id"]
        ),
        9,
    )


@query(
    "counter_increase_extrapolated",
    f"""WITH {_COUNTER},
    t AS (SELECT DISTINCT event_type, {be(DAY)} AS ts FROM smp),
    win AS (
      SELECT t.event_type, t.ts AS m_at, count(*) AS n, min(epoch_us(dd.ts)) AS f, max(epoch_us(dd.ts)) AS l,
        min_by(v, (dd.ts, event_id)) AS fv, sum(coalesce(delta, 0)) AS total,
        min_by(coalesce(delta, 0), (dd.ts, event_id)) AS fd
      FROM t JOIN dd ON t.event_type = dd.event_type AND dd.ts <= t.ts
        AND dd.ts > t.ts - INTERVAL {2 * DAY} SECONDS GROUP BY ALL),
    x AS (SELECT *, total - fd AS inc, (l - f) / 1e6 AS spread, (l - f) / 1e6 / (n - 1) AS between_,
        (f - (epoch_us(m_at) - {2 * DAY}000000)) / 1e6 AS s0, (epoch_us(m_at) - l) / 1e6 AS e0
      FROM win WHERE n > 1 AND l > f),
    y AS (SELECT *, least(s0, CASE WHEN inc > 0 THEN spread * fv / inc ELSE s0 END) AS s1 FROM x),
    z AS (SELECT *, inc * (spread + CASE WHEN s1 < 1.1 * between_ THEN s1 ELSE between_ / 2 END
        + CASE WHEN e0 < 1.1 * between_ THEN e0 ELSE between_ / 2 END) / spread AS increase FROM y)
    SELECT event_type, m_at AS ts, round(increase, 4) AS increase, round(increase / {2.0 * DAY}, 4) AS rate
    FROM z""",
)
def counter_increase_extrapolated(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(
        series.counter_increase(
            _samples(spark, sf), ["event_type"], 2 * DAY, DAY, tie=["event_id"], extrapolate=True
        ),
        4,
    )


@query(
    "changes",
    f"""WITH s AS (SELECT user_id, ts, event_id, event_type AS v FROM events),
    d AS (SELECT user_id, ts, coalesce((v <> lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT, 0) AS c FROM s),
    b AS (SELECT user_id, {be(DAY)} AS ts, sum(c) AS c FROM d GROUP BY 1, 2)
    SELECT user_id, ts, (sum(c) OVER {over(7 * DAY, DAY, 'user_id')})::BIGINT AS changes FROM b""",
)
def changes(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.col("event_type").alias("value")
    )
    return at_edge(series.changes(samples, ["user_id"], 7 * DAY, DAY, tie=["event_id"]))


@query(
    "sum_avg_by",
    """SELECT event_type, round(sum(value), 2) AS total, round(avg(value), 6) AS mean
    FROM events GROUP BY event_type""",
)
def sum_avg_by(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "events").select("event_type", "value")
    total = series.sum_by(samples, ["event_type"]).withColumn("total", F.round("value", 2)).drop("value")
    mean = series.avg_by(samples, ["event_type"]).withColumnRenamed("value", "mean")
    return at_edge(total.join(mean, "event_type"))


@query(
    "max_without",
    f"""WITH {REQ} SELECT service, round(max(value), 6) AS value FROM req GROUP BY service""",
)
def max_without(spark: SparkSession, sf: str) -> DataFrame:
    samples = requests(spark, sf).select("service", "event_type", "value")
    return at_edge(series.max_without(samples, ["event_type"]))


@query(
    "count_series",
    f"""WITH {REQ}, s AS (SELECT user_id, service, avg(value) AS value FROM req GROUP BY 1, 2)
    SELECT service, count(*) AS series, count(*) FILTER (value > 60) AS above FROM s GROUP BY service""",
)
def count_series(spark: SparkSession, sf: str) -> DataFrame:
    per_user = series.avg_by(requests(spark, sf), ["user_id", "service"])
    return per_user.groupBy("service").agg(
        F.count(F.lit(1)).alias("series"), F.count_if(F.col("value") > 60).alias("above")
    )


@query(
    "topk",
    f"""WITH b AS (SELECT user_id, {be(DAY)} AS ts, round(sum(value), 6) AS value FROM events GROUP BY 1, 2)
    SELECT ts, user_id, value FROM b
    QUALIFY row_number() OVER (PARTITION BY ts ORDER BY value DESC, user_id) <= 3""",
)
def topk(spark: SparkSession, sf: str) -> DataFrame:
    daily = series.buckets(
        table(spark, sf, "events"), ["user_id"], "ts", DAY, value=F.round(F.sum("value"), 6)
    )
    return at_edge(series.topk(daily, 3, tie=["user_id"]).select("ts", "user_id", "value"))


@query(
    "latency_quantiles",
    f"""WITH a AS (SELECT event_type, {be(DAY)} AS ts, value FROM events)
    SELECT event_type, ts, round(p50.quantile, 6) AS p50, round(p95.quantile, 6) AS p95,
      round(p99.quantile, 6) AS p99
    FROM {quantile_sql(0.5, 'a', 'event_type, ts')} p50
    JOIN {quantile_sql(0.95, 'a', 'event_type, ts')} p95 USING (event_type, ts)
    JOIN {quantile_sql(0.99, 'a', 'event_type, ts')} p99 USING (event_type, ts)""",
)
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    counted = series.buckets(
        table(spark, sf, "events"),
        ["event_type"],
        "ts",
        DAY,
        **series.cumulative_counts(F.col("value"), BOUNDS),
    )
    return at_edge(
        counted.select(
            "event_type",
            "ts",
            *[
                series.quantile_of_columns(q, BOUNDS).alias(name)
                for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
            ],
        )
    )


@query(
    "histogram_quantile_samples",
    f"""SELECT event_type, round(quantile, 6) AS quantile
    FROM {quantile_sql(0.95, 'events', 'event_type')}""",
)
def histogram_quantile_samples(spark: SparkSession, sf: str) -> DataFrame:
    """From samples in long form, one row per (label, le)."""
    events = table(spark, sf, "events")
    counted = events.groupBy("event_type").agg(
        *[c.alias(n) for n, c in series.cumulative_counts(F.col("value"), BOUNDS).items()]
    )
    names = [*map(str, BOUNDS), "Infinity"]
    samples = counted.select(
        "event_type",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(le).alias("le"), F.col(f"le_{i}").alias("value"))
                    for i, le in enumerate(names)
                ]
            )
        ),
    )
    return at_edge(series.quantile_by(samples, ["event_type"], 0.95))


@query(
    "error_rate_by_type",
    f"""WITH {REQ}
    SELECT service, round(count(*) FILTER (status = '500') / count(*), 6) AS value FROM req GROUP BY service""",
)
def error_rate_by_type(spark: SparkSession, sf: str) -> DataFrame:
    log = requests(spark, sf).withColumn("value", F.lit(1))
    bad = series.sum_by(series.matching(log, unlike={"status": "2.."}), ["service"])
    return at_edge(series.vector_op(bad, series.sum_by(log, ["service"]), ["service"], series.divide))


@query(
    "group_left_share",
    f"""WITH {REQ}
    SELECT service, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY service), 6) AS value
    FROM req GROUP BY service, event_type""",
)
def group_left_share(spark: SparkSession, sf: str) -> DataFrame:
    log = requests(spark, sf).withColumn("value", F.lit(1))
    many = series.sum_by(log, ["service", "event_type"])
    return at_edge(
        series.group_left(many, series.sum_by(many, ["service"]), ["service"], series.divide)
    )


@query(
    "vector_ignoring",
    f"""WITH {REQ}
    SELECT service, round(count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view'), 6) AS value
    FROM req GROUP BY service""",
)
def vector_ignoring(spark: SparkSession, sf: str) -> DataFrame:
    log = requests(spark, sf).withColumn("value", F.lit(1))
    counted = series.sum_by(log, ["service", "event_type"])
    left = series.matching(counted, equal={"event_type": "click"})
    right = series.matching(counted, equal={"event_type": "view"})
    return at_edge(series.vector_op_ignoring(left, right, ["event_type"], series.divide))


@query(
    "vector_and_or",
    """WITH s AS (SELECT user_id, sum(value) AS v, count(*) AS n, count(*) FILTER (event_type = 'error') AS e
      FROM events GROUP BY user_id)
    SELECT 'and' AS op, user_id, round(v, 2) AS value FROM s WHERE n > 60 AND e > 10
    UNION ALL SELECT 'or', user_id, round(CASE WHEN n > 60 THEN v ELSE e END, 2) FROM s WHERE n > 60 OR e > 10""",
)
def vector_and_or(spark: SparkSession, sf: str) -> DataFrame:
    per_user = table(spark, sf, "events").groupBy("user_id").agg(
        F.sum("value").alias("v"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("e"),
    )
    busy = per_user.filter("n > 60").select("user_id", F.col("v").alias("value"))
    bad = per_user.filter("e > 10").select("user_id", F.col("e").alias("value"))
    both = series.vector_and(busy, bad, ["user_id"]).select(F.lit("and").alias("op"), "*")
    either = series.vector_or(busy, bad, ["user_id"]).select(F.lit("or").alias("op"), "*")
    return at_edge(both.unionByName(either), 2)


@query(
    "or_default_floor",
    """SELECT u.user_id, coalesce(sum(e.n), 0)::BIGINT AS errors, greatest(coalesce(sum(e.n), 0), 1)::DOUBLE AS at_least_one
    FROM (SELECT DISTINCT user_id FROM events) u
    LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 100 GROUP BY 1) e USING (user_id)
    GROUP BY u.user_id""",
)
def or_default_floor(spark: SparkSession, sf: str) -> DataFrame:
    from driftline.functions.scalars import floor_at

    events = table(spark, sf, "events")
    errors = series.count_where(
        events.filter("event_type = 'error'"), ["user_id"], F.col("value") > 100, "n"
    )
    value = series.or_default(F.col("n"), 0)
    return events.select("user_id").distinct().join(errors, "user_id", "left").select(
        "user_id", value.alias("errors"), floor_at(value.cast("double"), 1.0).alias("at_least_one")
    )


@query(
    "label_matchers",
    f"""WITH {REQ} SELECT event_id, service, event_type, status FROM req
    WHERE status = '200' AND regexp_full_match(event_type, 'cl.*|view') AND NOT regexp_full_match(service, 'svc_[01]')""",
)
def label_matchers(spark: SparkSession, sf: str) -> DataFrame:
    return series.matching(
        requests(spark, sf),
        equal={"status": "200"},
        like={"event_type": "cl.*|view"},
        unlike={"service": "svc_[01]"},
    ).select("event_id", "service", "event_type", "status")


@query(
    "days_since",
    """SELECT user_id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 86400000000.0, 6) AS days
    FROM events GROUP BY user_id""",
)
def days_since(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2024-02-01").cast("timestamp")
    return at_edge(
        table(spark, sf, "events")
        .groupBy("user_id")
        .agg(F.max("ts").alias("last"))
        .select("user_id", series.days_since(F.col("last"), as_of).alias("days"))
    )


@query(
    "drift_over_time_average",
    f"""WITH {REQ}, b AS (SELECT service, {be(HOUR)} AS ts, count(*) FILTER (status = '500') / count(*) AS r FROM req GROUP BY 1, 2)
    SELECT service, ts, round(avg(r) OVER {over(DAY, HOUR)}, 6) AS mean_ratio FROM b""",
)
def average_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of hourly ratios over a day, not the ratio of daily sums."""
    hourly = series.buckets(
        requests(spark, sf), ["service"], "ts", HOUR, r=F.avg((F.col("status") == "500").cast("double"))
    )
    return at_edge(
        hourly.select(
            "service",
            "ts",
            series.average_over_time("r", ["service"], DAY, HOUR).alias("mean_ratio"),
        )
    )


# --- H: SLO -------------------------------------------------------------------

_SLO_BASE = f"""{REQ},
b AS (SELECT service, {be(slo.STEP)} AS ts, count(*) FILTER (status = '500') AS bad, count(*) AS total
      FROM req GROUP BY 1, 2),
spans AS (SELECT service, min(ts) AS lo, least((SELECT max(ts) FROM b), max(ts) + INTERVAL 30 DAYS) AS hi FROM b GROUP BY 1),
grid AS (SELECT service, unnest(generate_series(lo, hi, INTERVAL 5 MINUTES)) AS ts FROM spans),
f AS (SELECT service, ts, bad, total FROM grid LEFT JOIN b USING (service, ts)),
r AS (SELECT service, ts, {', '.join(f"sum(bad) OVER {over(w, slo.STEP)} / nullif(sum(total) OVER {over(w, slo.STEP)}, 0) AS ratio_{n}" for n, w in slo.WINDOWS.items())} FROM f),
rr AS (SELECT *, avg(ratio_5m) OVER {over(slo.PERIOD, slo.STEP)} AS ratio_period FROM r)"""

_OBJECTIVE = 0.95


def _ratios(spark: SparkSession, sf: str) -> DataFrame:
    counted = slo.request_buckets(
        requests(spark, sf), slo.bad_status(F.col("status")), ["service"]
    )
    return slo.error_ratios(counted, ["service"])


def _burned(spark: SparkSession, sf: str) -> DataFrame:
    # One objective per service, derived from the log.
    objectives = requests(spark, sf).select("service").distinct().withColumn(
        "objective", F.lit(_OBJECTIVE)
    )
    return slo.burn(_ratios(spark, sf), objectives, ["service"])


@query(
    "slo_ratios",
    f"""WITH {_SLO_BASE} SELECT service, ts, {', '.join(f'round(ratio_{n}, 6) AS ratio_{n}' for n in slo.WINDOWS)},
    round(ratio_period, 6) AS ratio_period FROM rr""",
)
def slo_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(_ratios(spark, sf).drop("bad", "total"))


@query(
    "slo_burn",
    f"""WITH {_SLO_BASE} SELECT service, ts, round(ratio_5m / (1 - 0.95::DOUBLE), 6) AS current_burn_rate,
    round(ratio_period / (1 - 0.95::DOUBLE), 6) AS period_burn_rate,
    round(1 - ratio_period / (1 - 0.95::DOUBLE), 6) AS budget_remaining FROM rr""",
)
def slo_burn(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(
        _burned(spark, sf).select(
            "service", "ts", "current_burn_rate", "period_burn_rate", "budget_remaining"
        )
    )


def _pair_sql(pairs) -> str:
    return " OR ".join(
        f"(ratio_{s} > {f} * (1 - 0.95::DOUBLE) AND ratio_{l} > {f} * (1 - 0.95::DOUBLE))" for f, s, l in pairs
    )


@query(
    "slo_alerts",
    f"""WITH {_SLO_BASE}, a AS (SELECT service, ts, coalesce({_pair_sql(slo.PAGE)}, false) AS page,
      coalesce({_pair_sql(slo.TICKET)}, false) AS ticket FROM rr)
    SELECT * FROM a WHERE page OR ticket""",
)
def slo_alerts(spark: SparkSession, sf: str) -> DataFrame:
    marked = slo.burn_alerts(_burned(spark, sf)).select("service", "ts", "page", "ticket")
    return at_edge(marked.filter(F.col("page") | F.col("ticket")))


@query(
    "slo_latency",
    f"""WITH {REQ}, b AS (SELECT service, {be(HOUR)} AS ts, count(*) FILTER (value / 1000 > 0.1) AS bad, count(*) AS total FROM req GROUP BY 1, 2)
    SELECT service, ts, bad, total, round(bad / total, 6) AS ratio FROM b""",
)
def slo_latency(spark: SparkSession, sf: str) -> DataFrame:
    counted = slo.request_buckets(
        requests(spark, sf), slo.too_slow(F.col("value") / 1000, 0.1), ["service"], step=HOUR
    )
    return at_edge(counted.withColumn("ratio", F.col("bad") / F.col("total")))


@query(
    "slo_pipeline_success",
    f"""WITH o AS (SELECT o_orderpriority AS pipeline, o_orderdate AS ts, o_orderstatus = 'F' AS bad FROM orders)
    SELECT pipeline, {be(DAY)} AS ts, count(*) FILTER (bad) AS bad, count(*) AS total,
      round(count(*) FILTER (bad) / count(*), 6) AS ratio FROM o GROUP BY 1, 2""",
)
def slo_pipeline_success(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("pipeline"),
        F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("Succeeded").alias("status"),
    )
    counted = slo.request_buckets(runs, slo.failed_run(F.col("status")), ["pipeline"], step=DAY)
    return at_edge(counted.withColumn("ratio", F.col("bad") / F.col("total")))


# --- I: alerts ----------------------------------------------------------------


def metric_table(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly metrics per service: every column the standard rules read, from one aggregation."""
    error = F.col("event_type") == "error"
    counted = series.buckets(
        requests(spark, sf),
        ["service"],
        "ts",
        HOUR,
        n=F.count(F.lit(1)),
        errors=F.count_if(error),
        clicks=F.count_if(F.col("event_type") == "click"),
        views=F.count_if(F.col("event_type") == "view"),
        mean=F.avg("value"),
        top=F.max("value"),
        **series.cumulative_counts(F.col("value"), BOUNDS),
    )
    n, mean = F.col("n"), F.col("mean")
    return counted.select(
        "service",
        F.concat(F.lit("ns_"), F.substring("service", 5, 1)).alias("namespace"),
        "ts",
        (series.quantile_of_columns(0.95, BOUNDS) / 100).alias("p95_seconds"),
        (series.quantile_of_columns(0.99, BOUNDS) / 100).alias("p99_seconds"),
        (F.col("errors") / n).alias("error_ratio"),
        F.col("errors").alias("restarts_1h"),
        (F.col("clicks") % 2).alias("up"),
        (F.col("views") / n).alias("failed_ratio_1h"),
        mean.alias("gpu_util"),
        alerts.memory_pct_of_total(F.col("top"), F.lit(500.0)).alias("gpu_memory_pct"),
        F.col("views").alias("replicas_available"),
        F.col("clicks").alias("replicas_wanted"),
        alerts.memory_pct_of_used_and_free(F.col("top"), mean).alias("volume_pct"),
        (mean * 10_000).alias("cert_seconds_left"),
        F.col("errors").alias("policy_failures_1h"),
        alerts.baseline_drop(F.lit(0.25), F.col("views") / n).alias("accuracy_drop"),
        alerts.version_gap(F.col("views") / n, F.col("clicks") / n).alias("accuracy_gap"),
        alerts.baseline_shrink(F.lit(4.0), n.cast("double")).alias("throughput_drop"),
        alerts.baseline_growth(F.lit(60.0), mean).alias("latency_growth"),
        (1 - F.col("errors") / n).alias("confidence"),
        (n * 10).alias("in_flight"),
        alerts.baseline_growth(F.lit(200.0), F.col("top")).alias("cost_growth"),
        (F.col("top") / 490).alias("memory_ratio"),
        (mean / 490).alias("node_memory_free_ratio"),
        (n * 8).alias("db_connections"),
        (F.col("errors") % 2).alias("pending"),
        F.col("views").alias("scaler_errors_5m"),
        F.col("clicks").alias("failed_runs"),
    )


_METRICS = f"""{REQ}, h AS (SELECT *, {be(HOUR)} AS hts FROM req),
m0 AS (SELECT service, hts AS ts, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
  count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views,
  avg(value) AS mean, max(value) AS top FROM h GROUP BY 1, 2),
q95 AS (SELECT service, hts AS ts, quantile / 100 AS p95_seconds FROM {quantile_sql(0.95, 'h', 'service, hts')}),
q99 AS (SELECT service, hts AS ts, quantile / 100 AS p99_seconds FROM {quantile_sql(0.99, 'h', 'service, hts')}),
m AS (SELECT *, 'ns_' || substr(service, 5, 1) AS namespace, errors / n AS error_ratio, errors AS restarts_1h, clicks % 2 AS up, views / n AS failed_ratio_1h,
  mean AS gpu_util, top / 500.0 * 100 AS gpu_memory_pct, views AS replicas_available, clicks AS replicas_wanted,
  top / (top + mean) * 100 AS volume_pct, mean * 10000 AS cert_seconds_left, errors AS policy_failures_1h,
  0.25::DOUBLE - views / n AS accuracy_drop, abs(views / n - clicks / n) AS accuracy_gap,
  (4.0::DOUBLE - n) / 4.0::DOUBLE AS throughput_drop, (mean - 60) / 60 AS latency_growth, 1 - errors / n AS confidence,
  n * 10 AS in_flight, (top - 200) / 200 AS cost_growth, top / 490 AS memory_ratio, mean / 490 AS node_memory_free_ratio,
  n * 8 AS db_connections, errors % 2 AS pending, views AS scaler_errors_5m, clicks AS failed_runs
  FROM m0 JOIN q95 USING (service, ts) JOIN q99 USING (service, ts)),
hits AS ({' UNION ALL '.join(f"SELECT '{r.name}' AS alertname, '{r.severity}' AS severity, {r.hold} AS hold, service, namespace, ts FROM m WHERE {r.condition}" for r in alerts.STANDARD_RULES)}),
isl AS (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY alertname, service ORDER BY ts)) AS island FROM hits),
act AS (SELECT alertname, severity, service, namespace, ts, min(ts) OVER (PARTITION BY alertname, service, island) AS active_since, hold FROM isl),
al AS (SELECT alertname, severity, service, namespace, ts, active_since,
  CASE WHEN epoch_us(ts) - epoch_us(active_since) >= hold::BIGINT * 1000000 THEN 'firing' ELSE 'pending' END AS state FROM act)"""


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    metrics = metric_table(spark, sf)
    rules = alerts.applicable(alerts.STANDARD_RULES, metrics)
    return alerts.evaluate(metrics, rules, ["service", "namespace"], HOUR)


@query("alert_rules", f"WITH {_METRICS} SELECT * FROM al")
def alert_rules(spark: SparkSession, sf: str) -> DataFrame:
    """All standard rules over the hourly metric table, with hold times."""
    return at_edge(_evaluated(spark, sf))


@query(
    "alerts_held",
    f"""WITH {REQ}, b AS (SELECT service, {be(HOUR)} AS ts, count(*) FILTER (status = '500') / count(*) AS r FROM req GROUP BY 1, 2),
    x AS (SELECT service, ts, ts - to_hours(row_number() OVER (PARTITION BY service ORDER BY ts)) AS g FROM b WHERE r > 0.05),
    y AS (SELECT service, ts, min(ts) OVER (PARTITION BY service, g) AS active_since FROM x)
    SELECT 'HighErrorRate' AS alertname, 'critical' AS severity, service, ts, active_since,
      CASE WHEN ts - active_since >= INTERVAL 2 HOURS THEN 'firing' ELSE 'pending' END AS state FROM y""",
)
def alerts_held(spark: SparkSession, sf: str) -> DataFrame:
    hourly = series.buckets(
        requests(spark, sf), ["service"], "ts", HOUR, r=F.avg((F.col("status") == "500").cast("double"))
    )
    return at_edge(
        alerts.alert(
            hourly, "HighErrorRate", F.col("r") > 0.05, ["service"], 2 * HOUR, "critical", HOUR
        )
    )


@query(
    "alerts_routed",
    f"""WITH {_METRICS} SELECT alertname, severity,
      CASE WHEN alertname = 'Watchdog' THEN 'null' WHEN severity = 'critical' THEN 'critical-alerts'
        WHEN severity = 'warning' THEN 'warning-alerts' ELSE 'null' END AS receiver, count(*) AS instants
    FROM al WHERE state = 'firing' GROUP BY 1, 2, 3""",
)
def alerts_routed(spark: SparkSession, sf: str) -> DataFrame:
    firing = _evaluated(spark, sf).filter("state = 'firing'")
    return (
        firing.withColumn("receiver", alerts.receiver(F.col("alertname"), F.col("severity")))
        .groupBy("alertname", "severity", "receiver")
        .agg(F.count(F.lit(1)).alias("instants"))
    )


_PAIRED = f"""{REQ}, b AS (SELECT service, {be(HOUR)} AS ts, count(*) FILTER (status = '500') / count(*) AS r, avg(value) AS v FROM req GROUP BY 1, 2),
fire AS (SELECT 'ServiceUnhealthy' AS alertname, service AS namespace, 'critical' AS severity, ts FROM b WHERE r > 0.4
  UNION ALL SELECT 'ServiceUnhealthy', service, 'warning', ts FROM b WHERE r > 0.1
  UNION ALL SELECT 'Slow', service, 'warning', ts FROM b WHERE v > 80)"""


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    hourly = series.record(
        series.buckets(
            requests(spark, sf),
            ["service"],
            "ts",
            HOUR,
            r=F.avg((F.col("status") == "500").cast("double")),
            v=F.avg("value"),
        ),
        "hourly",
    )

    def named(name: str, severity: str, condition: str) -> DataFrame:
        return hourly.filter(condition).select(
            F.lit(name).alias("alertname"),
            F.col("service").alias("namespace"),
            F.lit(severity).alias("severity"),
            "ts",
        )

    return (
        named("ServiceUnhealthy", "critical", "r > 0.4")
        .unionByName(named("ServiceUnhealthy", "warning", "r > 0.1"))
        .unionByName(named("Slow", "warning", "v > 80"))
    )


@query(
    "alerts_inhibited",
    f"""WITH {_PAIRED} SELECT * FROM fire f WHERE severity <> 'warning' OR NOT EXISTS (
      SELECT 1 FROM fire c WHERE c.severity = 'critical' AND c.alertname = f.alertname
        AND c.namespace = f.namespace AND c.ts = f.ts)""",
)
def alerts_inhibited(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(alerts.inhibit(_paired(spark, sf)))


@query(
    "alert_notifications",
    f"""WITH {_PAIRED},
    i AS (SELECT DISTINCT alertname, namespace, severity, ts FROM fire),
    s AS (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY alertname, namespace, severity ORDER BY ts)) AS g FROM i),
    t AS (SELECT *, min(ts) OVER (PARTITION BY alertname, namespace, severity, g) AS started FROM s),
    u AS (SELECT *, CASE WHEN ts = started THEN 0 ELSE ceil((epoch(ts) - epoch(started) - 30) / 300)::BIGINT END AS flush FROM t)
    SELECT alertname, namespace, severity, started + to_seconds(30 + flush * 300) AS sent_at,
      1::BIGINT AS alerts, CASE WHEN flush = 0 THEN 'new' ELSE 'repeat' END AS reason
    FROM u WHERE flush % 48 = 0""",
)
def alert_notifications(spark: SparkSession, sf: str) -> DataFrame:
    firing = _paired(spark, sf)
    return at_edge(alerts.notifications(firing, step_seconds=HOUR))


@query(
    "grouped_notifications",
    f"""WITH {_PAIRED},
    i AS (SELECT alertname, severity, ts, count(DISTINCT namespace) AS alerts,
      list_sort(list(DISTINCT namespace)) AS names FROM fire GROUP BY ALL),
    s AS (SELECT *, ts - to_hours(row_number() OVER (PARTITION BY alertname, severity ORDER BY ts)) AS g FROM i),
    t AS (SELECT *, min(ts) OVER (PARTITION BY alertname, severity, g) AS started FROM s),
    u AS (SELECT *, CASE WHEN ts = started THEN 0 ELSE ceil((epoch(ts) - epoch(started) - 30) / 300)::BIGINT END AS flush FROM t),
    v AS (SELECT *, lag(names) OVER (PARTITION BY alertname, severity, started ORDER BY flush) AS earlier FROM u),
    w AS (SELECT *, max(CASE WHEN earlier IS NULL OR earlier <> names THEN flush END) OVER (
      PARTITION BY alertname, severity, started ORDER BY flush ROWS UNBOUNDED PRECEDING) AS since FROM v)
    SELECT alertname, severity, started + to_seconds(30 + flush * 300) AS sent_at, alerts,
      CASE WHEN flush = 0 THEN 'new' WHEN flush = since THEN 'changed' ELSE 'repeat' END AS reason
    FROM w WHERE (flush - since) % 48 = 0""",
)
def grouped_notifications(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of several alerts: services come and go while a group fires."""
    firing = _paired(spark, sf)
    return at_edge(alerts.notifications(firing, ["alertname", "severity"], step_seconds=HOUR))


# --- J: canary ----------------------------------------------------------------

_CANARY_GRID = {"initial": 4 * HOUR, "interval": 4 * HOUR, "count": 5}
_CANARY_WINDOW = 8 * HOUR


def canary_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One analysis per service and day; a champion is known on even days."""
    days = requests(spark, sf).select(
        "service", F.date_trunc("day", "ts").alias("started_at")
    ).distinct()
    return days


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    grid = canary.measurement_grid(canary_runs(spark, sf), **_CANARY_GRID)
    return canary.measure(
        grid,
        requests(spark, sf),
        ["service"],
        F.col("status") == "200",
        "value",
        BOUNDS,
        ["service", "started_at"],
        window=_CANARY_WINDOW,
    )


_GATES = (
    canary.Gate("success-rate", "value >= 0.8", 2),
    canary.Gate("latency-p95", "value <= 240", 2),
    canary.Gate("error-rate", "value < 0.25", 1),
)

_CANARY = f"""{REQ},
runs AS (SELECT DISTINCT service, date_trunc('day', ts)::TIMESTAMP AS started_at FROM req),
grid AS (SELECT service, started_at, k::INT AS measurement, started_at + to_hours(CAST(4 + 4 * k AS INTEGER)) AS "at" FROM runs, range(5) AS r(k)),
hit AS (SELECT g.service, g.started_at, measurement, "at", status, value FROM grid g JOIN req q
  ON q.service = g.service AND q.ts <= "at" AND q.ts > "at" - INTERVAL 8 HOURS),
agg AS (SELECT service, started_at, measurement, count(*) AS n, count(*) FILTER (status = '200') AS ok FROM hit GROUP BY 1, 2, 3),
p AS (SELECT * FROM {quantile_sql(0.95, 'hit', 'service, started_at, measurement')}),
ms AS (SELECT service, started_at, measurement, "at", coalesce(ok, 0) / greatest(coalesce(n, 0)::DOUBLE, 1e-10) AS sr,
  coalesce(quantile, 0) AS p95, (coalesce(n, 0) - coalesce(ok, 0)) / greatest(coalesce(n, 0)::DOUBLE, 1e-10) AS er, coalesce(n, 0) = 0 AS no_traffic
  FROM grid LEFT JOIN agg USING (service, started_at, measurement) LEFT JOIN p USING (service, started_at, measurement)),
lg AS (SELECT service, started_at, measurement, "at", 'success-rate' AS metric, sr AS value, 2 AS failure_limit, sr >= 0.8 AS ok FROM ms
  UNION ALL SELECT service, started_at, measurement, "at", 'latency-p95', p95, 2, p95 <= 240 FROM ms
  UNION ALL SELECT service, started_at, measurement, "at", 'error-rate', er, 1, er < 0.25 FROM ms),
fl AS (SELECT *, (sum((NOT ok)::INT) OVER (PARTITION BY service, started_at, metric ORDER BY measurement))::BIGINT AS failures FROM lg),
ed AS (SELECT *, min(CASE WHEN failures > failure_limit THEN measurement END) OVER (PARTITION BY service, started_at) AS e FROM fl),
tk AS (SELECT * FROM ed WHERE e IS NULL OR measurement <= e),
mv AS (SELECT service, started_at, metric, failure_limit, count(*) AS count, max(failures) AS failed,
  CASE WHEN max(failures) > failure_limit THEN 'Failed' ELSE 'Successful' END AS phase FROM tk GROUP BY 1, 2, 3, 4)"""


@query(
    "canary_measurements",
    f"""WITH {_CANARY} SELECT service, started_at, measurement, "at", round(sr, 6) AS success_rate,
    round(p95, 6) AS latency_p95, round(er, 6) AS error_rate, no_traffic FROM ms""",
)
def canary_measurements(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(
        _measured(spark, sf).withColumnsRenamed(
            {"success-rate": "success_rate", "latency-p95": "latency_p95", "error-rate": "error_rate"}
        )
    )


@query(
    "canary_metric_verdicts",
    f"WITH {_CANARY} SELECT * FROM mv",
)
def canary_metric_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    run = ["service", "started_at"]
    taken = canary.measurements(_measured(spark, sf), run, _GATES)
    return at_edge(canary.metric_verdicts(taken, run))


@query(
    "canary_verdict",
    f"""WITH {_CANARY} SELECT service, started_at, count(*) AS metrics, count(*) FILTER (phase = 'Failed') AS failed_metrics,
      CASE WHEN bool_or(phase = 'Failed') THEN 'Failed' ELSE 'Successful' END AS phase,
      min(CASE WHEN phase = 'Failed' THEN format('Metric "{{}}" assessed Failed due to failed ({{}}) > failureLimit ({{}})', metric, failed, failure_limit) END) AS message,
      CASE WHEN NOT bool_or(phase = 'Failed') THEN 'keep' WHEN day(started_at) % 2 = 0 THEN 'rollback' ELSE 'fail' END AS action
    FROM mv GROUP BY service, started_at""",
)
def canary_verdict(spark: SparkSession, sf: str) -> DataFrame:
    run = ["service", "started_at"]
    taken = canary.measurements(_measured(spark, sf), run, _GATES)
    verdicts = canary.metric_verdicts(taken, run)
    champion = F.first(F.when(F.dayofmonth("started_at") % 2 == 0, F.lit("champion")))
    return at_edge(canary.run_verdicts(verdicts, run, champion))


_CVS = f"""{REQ}, h AS (SELECT *, {be(DAY)} AS d FROM req),
c AS (SELECT service, d AS ts, count(*) FILTER (canary AND status = '500') / nullif(count(*) FILTER (canary), 0) AS ce,
  count(*) FILTER (NOT canary AND status = '500') / nullif(count(*) FILTER (NOT canary), 0) AS se FROM h GROUP BY 1, 2),
hc AS (SELECT * FROM h WHERE canary), hs AS (SELECT * FROM h WHERE NOT canary),
x AS (SELECT service, c.ts, ce, se, a.quantile AS cp, b.quantile AS sp FROM c
  LEFT JOIN (SELECT service, d AS ts, quantile FROM {quantile_sql(0.95, 'hc', 'service, d')}) a USING (service, ts)
  LEFT JOIN (SELECT service, d AS ts, quantile FROM {quantile_sql(0.95, 'hs', 'service, d')}) b USING (service, ts)),
cv AS (SELECT service, ts, ce, se, cp, sp, ce > se * 1.5::DOUBLE AS worse_errors, cp > sp * 1.3::DOUBLE AS worse_latency FROM x)"""


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return canary.canary_vs_stable(
        requests(spark, sf),
        ["service"],
        F.col("canary"),
        F.col("status") != "200",
        "value",
        BOUNDS,
        series.bucket_end(F.col("ts"), DAY),
    )


@query(
    "canary_vs_stable",
    f"""WITH {_CVS} SELECT service, ts, round(ce, 6) AS canary_error_ratio, round(se, 6) AS stable_error_ratio,
    round(cp, 6) AS canary_p95, round(sp, 6) AS stable_p95, worse_errors, worse_latency FROM cv""",
)
def canary_vs_stable(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(_compared(spark, sf))


@query(
    "canary_alerts",
    f"""WITH {_CVS}, hits AS (
      SELECT 'CanaryHigherErrorRate' AS alertname, 'critical' AS severity, service, ts FROM cv WHERE worse_errors
      UNION ALL SELECT 'CanaryHigherLatency', 'warning', service, ts FROM cv WHERE worse_latency),
    i AS (SELECT *, ts - to_days(row_number() OVER (PARTITION BY alertname, service ORDER BY ts)::INT) AS g FROM hits),
    j AS (SELECT *, min(ts) OVER (PARTITION BY alertname, service, g) AS active_since FROM i)
    SELECT alertname, severity, service, ts, active_since,
      CASE WHEN ts - active_since >= INTERVAL 1 DAY THEN 'firing' ELSE 'pending' END AS state FROM j""",
)
def canary_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(canary.canary_alerts(_compared(spark, sf), ["service"], DAY, DAY))


@query(
    "next_traffic",
    f"""WITH {_CVS} SELECT service, ts, (10 * (1 + day(ts) % 10))::INT AS current_share,
      CASE 10 * (1 + day(ts) % 10) WHEN 10 THEN 25 WHEN 50 THEN 100 WHEN 100 THEN 100 END AS next_share
    FROM cv WHERE NOT coalesce(worse_errors, false)""",
)
def next_traffic(spark: SparkSession, sf: str) -> DataFrame:
    healthy = _compared(spark, sf).filter(~F.coalesce("worse_errors", F.lit(False)))
    share = (10 * (1 + F.dayofmonth("ts") % 10)).cast("int")
    return at_edge(
        healthy.select(
            "service", "ts", share.alias("current_share"), canary.next_traffic(share).alias("next_share")
        )
    )


@query(
    "version_comparison",
    f"""WITH {REQ}, h AS (SELECT CASE WHEN canary THEN 'canary' ELSE 'stable' END AS version, {be(DAY)} AS d, status, value FROM req)
    SELECT version, d AS ts, requests, round(success_rate, 6) AS success_rate, round(quantile, 6) AS p95 FROM (
      SELECT version, d, count(*) AS requests, avg((status = '200')::INT) AS success_rate FROM h GROUP BY 1, 2)
    JOIN {quantile_sql(0.95, 'h', 'version, d')} USING (version, d)""",
)
def version_comparison(spark: SparkSession, sf: str) -> DataFrame:
    log = requests(spark, sf).withColumn(
        "version", F.when(F.col("canary"), "canary").otherwise("stable")
    )
    return at_edge(
        canary.version_comparison(
            log,
            ["version"],
            F.col("status") == "200",
            "value",
            BOUNDS,
            series.bucket_end(F.col("ts"), DAY),
        )
    )


@query(
    "load_gate",
    """WITH q AS (SELECT 'p95' AS metric, quantile_cont(value, 0.95) AS value FROM events
      UNION ALL SELECT 'p99', quantile_cont(value, 0.99) FROM events
      UNION ALL SELECT 'inference_p95', quantile_cont(value, 0.95) FROM events WHERE event_type IN ('click', 'view')
      UNION ALL SELECT 'failed_share', avg((event_type = 'error')::INT) FROM events
      UNION ALL SELECT 'check_error_share', avg((value > 480)::INT) FROM events)
    SELECT metric, round(value, 6) AS value, CASE metric WHEN 'p95' THEN value < 500 WHEN 'p99' THEN value < 1000
      WHEN 'failed_share' THEN value < 0.05 WHEN 'check_error_share' THEN value < 0.01 ELSE value < 400 END AS passed FROM q""",
)
def load_gate(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(
        canary.load_gate(
            requests(spark, sf),
            "value",
            F.col("event_type") == "error",
            F.col("value") > 480,
            F.col("event_type").isin("click", "view"),
        )
    )
