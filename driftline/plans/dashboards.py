"""Dashboards as queries: every panel gives rows (panel, series, ts, value, band).

A dashboard is the union of its panels. ``ts`` is null for single numbers;
``band`` is the colour of the panel's thresholds, where it has some. Panels over
the request log read one recorded daily table, not the log itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import band
from driftline.operators import cost, drift, series
from driftline.plans import drift as drift_plan
from driftline.plans import models, monitoring, records
from driftline.plans.registry import at_edge, query, table

DAY = 86_400
BOUNDS = monitoring.BOUNDS

# Colour steps of the panels.
DRIFT_STEPS = ((0.1, "yellow"), (0.2, "red"))
ERROR_PCT_STEPS = ((1.0, "yellow"), (5.0, "red"))


@dataclass
class Panel:
    """Spark form (rows of series, ts, value) and SQL form of one panel."""

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    sql: str
    steps: Sequence[tuple[float, str]] = field(default_factory=tuple)


def rows(df: DataFrame, name: Column | str | None, ts: Column | str | None, value: Column) -> DataFrame:
    def col(c, empty: str) -> Column:
        if c is None:
            return F.lit(None).cast(empty)
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        col(name, "string").cast("string").alias("series"),
        col(ts, "timestamp").cast("timestamp").alias("ts"),
        value.cast("double").alias("value"),
    )


def dashboard(panels: Sequence[Panel], base: dict[str, DataFrame]) -> DataFrame:
    out = None
    for p in panels:
        colour = band(F.col("value"), p.steps) if p.steps else F.lit(None).cast("string")
        part = p.build(base).select(
            F.lit(p.name).alias("panel"), "series", "ts", "value", colour.alias("band")
        )
        out = part if out is None else out.unionAll(part)
    return at_edge(out)


def dashboard_sql(panels: Sequence[Panel], ctes: str) -> str:
    parts = []
    for p in panels:
        colour = "NULL::VARCHAR"
        if p.steps:
            tests = " ".join(f"WHEN value >= {t} THEN '{n}'" for t, n in sorted(p.steps, reverse=True))
            colour = f"CASE WHEN value IS NULL THEN NULL {tests} ELSE 'green' END"
        parts.append(
            f"SELECT '{p.name}' AS panel, series::VARCHAR AS series, ts::TIMESTAMP AS ts, "
            f"round(value::DOUBLE, 6) AS value, {colour} AS band FROM ({p.sql})"
        )
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


# --- requests: model performance and two overviews ----------------------------


def request_base(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The daily recorded tables: by service and type, and by user."""
    log = monitoring.requests(spark, sf)
    daily = series.record(
        series.buckets(
            log,
            ["service", "event_type"],
            "ts",
            DAY,
            n=F.count(F.lit(1)),
            errors=F.count_if(F.col("status") == "500"),
            total=F.sum("value"),
            **series.cumulative_counts(F.col("value"), BOUNDS),
        ),
        "daily",
    )
    les = [f"le_{i}" for i in range(len(BOUNDS) + 1)]
    sums = [F.sum(c).alias(c) for c in ("n", "errors", *les)]
    by_user = series.record(
        log.groupBy("user_id", "service").agg(
            F.sum("value").alias("cpu"), F.count(F.lit(1)).alias("memory")
        ),
        "users",
    )
    return {
        "typed": daily,
        "service": daily.groupBy("service", "ts").agg(*sums),
        "all": daily.groupBy("ts").agg(*sums),
        "total": daily.agg(*sums),
        "users": by_user,
        "log": log,
    }


_Q = monitoring.quantile_sql
_REQUEST_CTES = f"""{monitoring.REQ}, dd AS (SELECT *, {monitoring.be(DAY)} AS d, 1 AS one FROM req),
ps AS (SELECT service, d, count(*) AS n, count(*) FILTER (status = '500') AS errors FROM dd GROUP BY 1, 2),
us AS (SELECT user_id, service, sum(value) AS cpu, count(*) AS memory FROM req GROUP BY 1, 2)"""


def _quantile_panel(name: str, q: float, source: str, scale: float = 1.0) -> Panel:
    if source == "total":
        sql = f"SELECT NULL AS series, NULL AS ts, quantile * {scale} AS value FROM {_Q(q, 'dd', 'one')}"
        label, ts = None, None
    else:
        sql = f"SELECT service AS series, d AS ts, quantile * {scale} AS value FROM {_Q(q, 'dd', 'service, d')}"
        label, ts = "service", "ts"
    return Panel(
        name,
        lambda b: rows(b[source], label, ts, series.quantile_of_columns(q, BOUNDS) * scale),
        sql,
    )


def _rate_panel(name: str, source: str) -> Panel:
    if source == "all":
        return Panel(
            name,
            lambda b: rows(b["all"], None, "ts", F.col("n") / DAY),
            f"SELECT NULL AS series, d AS ts, count(*) / {DAY}.0 AS value FROM dd GROUP BY d",
        )
    return Panel(
        name,
        lambda b: rows(b["service"], "service", "ts", F.col("n") / DAY),
        f"SELECT service AS series, d AS ts, n / {DAY}.0 AS value FROM ps",
    )


def _error_ratio_panel(name: str, scale: float = 1.0, steps=()) -> Panel:
    return Panel(
        name,
        lambda b: rows(b["total"], None, None, F.col("errors") / F.col("n") * scale),
        f"SELECT NULL AS series, NULL AS ts, count(*) FILTER (status = '500') / count(*) * {scale} AS value FROM dd",
        steps,
    )


def _up_panel(name: str) -> Panel:
    def build(b: dict[str, DataFrame]) -> DataFrame:
        full = series.dense(b["service"].select("service", "ts", "n"), ["service"], DAY)
        return rows(full, "service", "ts", F.when(series.or_default(F.col("n"), 0) > 0, 1).otherwise(0))

    return Panel(
        name,
        build,
        """SELECT service AS series, day AS ts, (n IS NOT NULL)::INT AS value FROM
        (SELECT service, unnest(generate_series((SELECT min(d) FROM ps), (SELECT max(d) FROM ps), INTERVAL 1 DAY)) AS day FROM (SELECT DISTINCT service FROM ps))
        LEFT JOIN (SELECT service, d AS day, n FROM ps) USING (service, day)""",
    )


def _share_of_service(name: str, column: str) -> Panel:
    def build(b: dict[str, DataFrame]) -> DataFrame:
        quota = b["users"].groupBy("service").agg(F.sum(column).alias("value"))
        used = b["users"].select("user_id", "service", F.col(column).alias("value"))
        shares = series.group_left(used, quota, ["service"], series.divide)
        return rows(shares, F.concat_ws("/", "service", F.col("user_id").cast("string")), None, F.col("value"))

    return Panel(
        name,
        build,
        f"SELECT service || '/' || user_id AS series, NULL AS ts, {column} / sum({column}) OVER (PARTITION BY service) AS value FROM us",
    )


def _sum_by_user(name: str, column: str) -> Panel:
    return Panel(
        name,
        lambda b: rows(b["users"], F.col("user_id").cast("string"), None, F.round(column, 2)),
        f"SELECT user_id AS series, NULL AS ts, round({column}, 2) AS value FROM us",
    )


def _fallback(name: str, first: str, second: str) -> Panel:
    """One metric, or another where the first is absent."""

    def build(b: dict[str, DataFrame]) -> DataFrame:
        def metric(kind: str) -> DataFrame:
            typed = series.matching(b["typed"], equal={"event_type": kind})
            return typed.select("service", "ts", (F.col("total") / F.col("n")).alias("value"))

        either = series.vector_or(metric(first), metric(second), ["service", "ts"])
        return rows(either, "service", "ts", F.col("value"))

    return Panel(
        name,
        build,
        f"""SELECT service AS series, d AS ts, coalesce(avg(value) FILTER (event_type = '{first}'), avg(value) FILTER (event_type = '{second}')) AS value
        FROM dd GROUP BY 1, 2 HAVING count(*) FILTER (event_type IN ('{first}', '{second}')) > 0""",
    )


def _version_changes(name: str) -> Panel:
    def build(b: dict[str, DataFrame]) -> DataFrame:
        versions = b["log"].select("service", "ts", "event_id", F.col("canary").alias("value"))
        changed = series.changes(versions, ["service"], DAY, DAY, tie=["event_id"])
        return rows(changed, "service", "ts", F.col("changes"))

    return Panel(
        name,
        build,
        """SELECT service AS series, d AS ts, sum(c) AS value FROM (SELECT service, d,
        coalesce((canary <> lag(canary) OVER (PARTITION BY service ORDER BY ts, event_id))::INT, 0) AS c FROM dd) GROUP BY 1, 2""",
    )


def _per_service(name: str, value: Callable[[], Column], sql_value: str) -> Panel:
    return Panel(
        name,
        lambda b: rows(b["service"], "service", "ts", value()),
        f"SELECT service AS series, d AS ts, {sql_value} AS value FROM ps",
    )


PERFORMANCE = [
    _quantile_panel("p50_ms", 0.5, "total"),
    _quantile_panel("p99_ms", 0.99, "total"),
    _error_ratio_panel("error_ratio", 1.0, ((0.01, "yellow"), (0.05, "red"))),
    _rate_panel("throughput", "all"),
    _quantile_panel("p50_by_model", 0.5, "service"),
    _quantile_panel("p95_by_model", 0.95, "service"),
    _quantile_panel("p99_by_model", 0.99, "service"),
    _rate_panel("rate_by_model", "service"),
    _up_panel("endpoint_up"),
    Panel(
        "share_by_model_and_type",
        lambda b: rows(
            series.group_left(
                b["typed"].select("service", "event_type", "ts", F.col("n").alias("value")),
                b["service"].select("service", "ts", F.col("n").alias("value")),
                ["service", "ts"],
                series.divide,
            ),
            F.concat_ws("/", "service", "event_type"),
            "ts",
            F.col("value"),
        ),
        "SELECT service || '/' || event_type AS series, d AS ts, count(*) / sum(count(*)) OVER (PARTITION BY service, d) AS value FROM dd GROUP BY service, event_type, d",
    ),
    _share_of_service("cpu_of_quota_by_pod", "cpu"),
    _sum_by_user("memory_by_pod", "memory"),
    _fallback("gpu_utilisation", "click", "view"),
    _fallback("gpu_memory", "signup", "purchase"),
    _version_changes("version_changes"),
]

OVERVIEW = [
    Panel(
        "success_ratio",
        lambda b: rows(b["total"], None, None, 1 - F.col("errors") / F.col("n")),
        "SELECT NULL AS series, NULL AS ts, count(*) FILTER (status = '200') / count(*) AS value FROM dd",
    ),
    _quantile_panel("p95_ms", 0.95, "total"),
    _rate_panel("throughput", "all"),
    Panel(
        "active_services",
        lambda b: rows(
            series.matching(b["service"], like={"service": "svc_.*"}).agg(
                F.count_distinct("service").alias("v")
            ),
            None,
            None,
            F.col("v"),
        ),
        "SELECT NULL AS series, NULL AS ts, count(DISTINCT service) AS value FROM ps",
    ),
    _per_service("requests_by_model", lambda: F.col("n"), "n"),
    _quantile_panel("p50_by_model", 0.5, "service"),
    _quantile_panel("p95_by_model", 0.95, "service"),
    _quantile_panel("p99_by_model", 0.99, "service"),
    _share_of_service("memory_of_limit", "memory"),
    _share_of_service("cpu_of_quota", "cpu"),
    _up_panel("service_health"),
    _rate_panel("requests_per_second", "all"),
    Panel(
        "active_models",
        lambda b: rows(
            b["service"].agg(F.count_distinct("service").alias("v")), None, None, F.col("v")
        ),
        "SELECT NULL AS series, NULL AS ts, count(DISTINCT service) AS value FROM ps",
    ),
    _error_ratio_panel("error_pct", 100.0, ERROR_PCT_STEPS),
    _rate_panel("rate_by_model", "service"),
]


@query("dash_performance", dashboard_sql(PERFORMANCE, _REQUEST_CTES))
def dash_performance(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(PERFORMANCE, request_base(spark, sf))


@query("dash_overview", dashboard_sql(OVERVIEW, _REQUEST_CTES))
def dash_overview(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(OVERVIEW, request_base(spark, sf))


# --- drift --------------------------------------------------------------------


def drift_base(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    before, after = drift_plan.sides(spark, sf)
    events = table(spark, sf, "events")
    return {
        "features": series.record(drift.detect_drift(before, after), "drift"),
        "metrics": table(spark, sf, "lineitem"),
        "events": events,
        "runs": records.runs_table(spark, sf),
    }




def _feature_panel(name: str, column: str, steps=()) -> Panel:
    return Panel(
        name,
        lambda b: rows(
            b["features"], "feature", F.lit("2001-12-01").cast("timestamp"), F.col(column)
        ),
        f"SELECT feature AS series, TIMESTAMP '2001-12-01' AS ts, {column} AS value FROM result",
        steps,
    )


DRIFT = [
    Panel(
        "max_score",
        lambda b: rows(drift.drift_rollup(b["features"]), None, None, F.col("max_score")),
        "SELECT NULL AS series, NULL AS ts, max(drift_score) AS value FROM result",
        DRIFT_STEPS,
    ),
    Panel(
        "max_ks",
        lambda b: rows(drift.drift_rollup(b["features"]), None, None, F.col("max_ks")),
        "SELECT NULL AS series, NULL AS ts, max(ks_statistic) AS value FROM result",
        DRIFT_STEPS,
    ),
    Panel(
        "features_above",
        lambda b: rows(drift.drift_rollup(b["features"]), None, None, F.col("features_above")),
        "SELECT NULL AS series, NULL AS ts, count(*) FILTER (drift_score > 0.1) AS value FROM result",
    ),
    Panel(
        "days_since_training",
        lambda b: rows(
            b["runs"].groupBy("model").agg(F.max("ts").alias("t")),
            "model",
            None,
            series.days_since(F.col("t"), F.lit("2024-02-01").cast("timestamp")),
        ),
        f"SELECT model AS series, NULL AS ts, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 86400000000.0 AS value FROM runs GROUP BY model",
    ),
    _feature_panel("score_over_time", "drift_score", DRIFT_STEPS),
    Panel(
        "top_10",
        lambda b: rows(drift.top_drifted(b["features"]), "feature", None, F.col("drift_score")),
        "SELECT feature AS series, NULL AS ts, drift_score AS value FROM result ORDER BY drift_score DESC, feature LIMIT 10",
    ),
    _feature_panel("ks_over_time", "ks_statistic"),
    _feature_panel("psi_over_time", "psi"),
    Panel(
        "accuracy_over_time",
        lambda b: rows(
            b["runs"].filter(F.element_at("metrics", "accuracy").isNotNull()),
            F.concat_ws("/", "model", F.col("run_id").cast("string")),
            "ts",
            F.element_at("metrics", "accuracy"),
        ),
        "SELECT model || '/' || run_id AS series, ts, accuracy AS value FROM runs WHERE accuracy IS NOT NULL",
    ),
    Panel(
        "class_distribution",
        lambda b: rows(
            models.model.prediction_distribution(
                b["events"], "event_type", series.bucket_end(F.col("ts"), DAY)
            ),
            "class",
            "ts",
            F.col("share"),
        ),
        f"SELECT event_type AS series, d AS ts, count(*) / sum(count(*)) OVER (PARTITION BY d) AS value FROM (SELECT event_type, {monitoring.be(DAY)} AS d FROM events) GROUP BY event_type, d",
    ),
    Panel(
        "retraining_marker",
        lambda b: rows(
            series.changes(
                b["runs"].select("model", "ts", "run_id", F.col("experiment_id").alias("value")),
                ["model"],
                DAY,
                DAY,
                tie=["run_id"],
            ),
            "model",
            "ts",
            F.col("changes"),
        ),
        f"""SELECT model AS series, d AS ts, sum(c) AS value FROM (SELECT model, {monitoring.be(DAY)} AS d,
        coalesce((experiment_id <> lag(experiment_id) OVER (PARTITION BY model ORDER BY ts, run_id))::INT, 0) AS c FROM runs) GROUP BY 1, 2""",
    ),
]


@query("dash_drift", dashboard_sql(DRIFT, f"{drift_plan._ALL_CTE}, {records._RUNS}"))
def dash_drift(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(DRIFT, drift_base(spark, sf))


# --- pipeline -----------------------------------------------------------------


def pipeline_base(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "Succeeded")
        .when(kind == "error", "Failed")
        .when(kind == "signup", "Error")
        .otherwise("Running")
    )
    log = table(spark, sf, "events").withColumn("status", status)
    day = series.bucket_end(F.col("ts"), DAY).alias("ts")
    return {
        "status": series.record(
            log.groupBy(day, "status").agg(F.count(F.lit(1)).alias("n")), "status"
        ),
        "steps": records.logs.step_durations(records._logs(spark, sf)),
        "runs": records.runs_table(spark, sf),
        "pods": series.record(
            table(spark, sf, "lineitem")
            .groupBy("l_suppkey")
            .agg(F.sum("l_quantity").alias("cpu"), F.sum("l_linenumber").alias("memory")),
            "pods",
        ),
    }


_STATES = {"running": "Running", "succeeded": "Succeeded", "failed": "Failed", "error": "Error"}
_PIPELINE_CTES = f"""{records._LOG}, {records._RUNS},
stt AS (SELECT {monitoring.be(DAY)} AS d, CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Error' ELSE 'Running' END AS status, count(*) AS n FROM events GROUP BY 1, 2),
pod AS (SELECT l_suppkey, sum(l_quantity) AS cpu, sum(l_linenumber) AS memory FROM lineitem GROUP BY 1)"""


def _state_panel(name: str, state: str) -> Panel:
    return Panel(
        name,
        lambda b: rows(b["status"].filter(F.col("status") == state), None, "ts", F.col("n")),
        f"SELECT NULL AS series, d AS ts, n AS value FROM stt WHERE status = '{state}'",
    )


PIPELINE = [
    *[_state_panel(n, s) for n, s in _STATES.items()],
    Panel(
        "step_duration",
        lambda b: rows(
            b["steps"].filter("seconds IS NOT NULL"),
            F.concat_ws("/", "correlation_id", "step"),
            "started",
            F.col("seconds"),
        ),
        """SELECT run || '/' || step AS series, s AS ts, (epoch_us(c) - epoch_us(s)) / 1e6 AS value FROM (SELECT run, step,
        min(ts) FILTER (event = 'step_start') AS s, max(ts) FILTER (event = 'step_complete') AS c FROM ok GROUP BY 1, 2) WHERE s IS NOT NULL AND c IS NOT NULL""",
    ),
    Panel(
        "accuracy_trend",
        lambda b: rows(
            b["runs"].filter(F.element_at("metrics", "accuracy").isNotNull()),
            "model",
            "ts",
            F.element_at("metrics", "accuracy"),
        ),
        "SELECT model AS series, ts, accuracy AS value FROM runs WHERE accuracy IS NOT NULL",
    ),
    Panel(
        "cpu_by_pod",
        lambda b: rows(b["pods"], F.col("l_suppkey").cast("string"), None, F.col("cpu")),
        "SELECT l_suppkey AS series, NULL AS ts, cpu AS value FROM pod",
    ),
    Panel(
        "memory_by_pod",
        lambda b: rows(b["pods"], F.col("l_suppkey").cast("string"), None, F.col("memory")),
        "SELECT l_suppkey AS series, NULL AS ts, memory AS value FROM pod",
    ),
]


@query("dash_pipeline", dashboard_sql(PIPELINE, _PIPELINE_CTES))
def dash_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(PIPELINE, pipeline_base(spark, sf))


# --- delivery -----------------------------------------------------------------


def delivery_base(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    replicas = records.replica_table(spark, sf)
    return {
        "runs": series.record(monitoring.canary_verdict(spark, sf), "verdicts"),
        "traffic": monitoring.next_traffic(spark, sf),
        "replicas": replicas.select(
            F.concat_ws("/", "namespace", "name").alias("resource"),
            F.coalesce("ready_replicas", F.lit(0)).alias("available"),
            F.greatest(
                F.coalesce("replicas", F.lit(1)) - F.coalesce("ready_replicas", F.lit(0)), F.lit(0)
            ).alias("unavailable"),
        ),
        "versions": series.record(monitoring.version_comparison(spark, sf), "versions"),
    }


def _delivery_ctes() -> str:
    from driftline.plans.registry import ORACLES

    return f"""cv_runs AS ({ORACLES['canary_verdict']}), nt AS ({ORACLES['next_traffic']}), vc AS ({ORACLES['version_comparison']}),
    rep AS (SELECT 'ns-' || (p_partkey % 5) || '/deploy-' || p_partkey AS resource, CASE WHEN p_partkey % 3 <> 0 THEN p_size % 6 ELSE 0 END AS available,
      greatest(CASE WHEN p_size % 6 > 0 THEN p_size % 6 ELSE 1 END - CASE WHEN p_partkey % 3 <> 0 THEN p_size % 6 ELSE 0 END, 0) AS unavailable FROM part)"""


def _phase_count(name: str, phase: str) -> Panel:
    return Panel(
        name,
        lambda b: rows(
            b["runs"].agg(F.count_if(F.col("phase") == phase).alias("v")), None, None, F.col("v")
        ),
        f"SELECT NULL AS series, NULL AS ts, count(*) FILTER (phase = '{phase}') AS value FROM cv_runs",
    )


DELIVERY = [
    Panel(
        "phase",
        lambda b: rows(
            b["runs"], F.concat_ws("/", "service", "phase"), "started_at", F.col("failed_metrics")
        ),
        "SELECT service || '/' || phase AS series, started_at AS ts, failed_metrics AS value FROM cv_runs",
    ),
    Panel(
        "canary_share",
        lambda b: rows(b["traffic"], "service", "ts", F.col("current_share")),
        "SELECT service AS series, ts, current_share AS value FROM nt",
    ),
    Panel(
        "available",
        lambda b: rows(b["replicas"], "resource", None, F.col("available")),
        "SELECT resource AS series, NULL AS ts, available AS value FROM rep",
    ),
    Panel(
        "unavailable",
        lambda b: rows(b["replicas"], "resource", None, F.col("unavailable")),
        "SELECT resource AS series, NULL AS ts, unavailable AS value FROM rep",
    ),
    Panel(
        "success_by_version",
        lambda b: rows(b["versions"], "version", "ts", F.col("success_rate")),
        "SELECT version AS series, ts, success_rate AS value FROM vc",
    ),
    Panel(
        "p95_by_version",
        lambda b: rows(b["versions"], "version", "ts", F.col("p95")),
        "SELECT version AS series, ts, p95 AS value FROM vc",
    ),
    _phase_count("runs_successful", "Successful"),
    _phase_count("runs_failed", "Failed"),
    _phase_count("runs_inconclusive", "Inconclusive"),
]


@query("dash_delivery", dashboard_sql(DELIVERY, _delivery_ctes()))
def dash_delivery(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(DELIVERY, delivery_base(spark, sf))


# --- GPU ----------------------------------------------------------------------


def gpu_base(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """One device per return flag; months of shipping as time."""
    devices = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("device"),
        F.date_trunc("month", "l_shipdate").alias("ts"),
        (F.col("l_discount") * 1000).alias("gpu_util_pct"),
        F.col("l_quantity").alias("mem_used"),
        (50 - F.col("l_quantity")).alias("mem_free"),
        (F.col("l_tax") * 1000).alias("temperature"),
        (F.col("l_quantity") * 5).alias("power"),
    )
    return {"now": cost.gpu_rollup(devices, ["device"]), "time": series.record(cost.gpu_rollup(devices, ["device", "ts"]), "gpu")}


_GPU_CTES = """g AS (SELECT l_returnflag AS device, date_trunc('month', l_shipdate)::TIMESTAMP AS ts, l_discount * 1000 AS util_pct, l_quantity / 50 * 100 AS memory_pct,
  l_quantity AS mem_used, 50 - l_quantity AS mem_free, l_tax * 1000 AS temperature, l_quantity * 5 AS power FROM lineitem)"""


def _gpu_panel(name: str, column: str, over_time: bool) -> Panel:
    agg = "sum" if column.startswith("mem_") else "avg"
    if over_time:
        return Panel(
            name,
            lambda b: rows(b["time"], "device", "ts", F.col(column)),
            f"SELECT device AS series, ts, {agg}({column}) AS value FROM g GROUP BY 1, 2",
        )
    return Panel(
        name,
        lambda b: rows(b["now"], "device", None, F.col(column)),
        f"SELECT device AS series, NULL AS ts, {agg}({column}) AS value FROM g GROUP BY 1",
    )


GPU = [
    _gpu_panel("utilisation", "util_pct", False),
    _gpu_panel("memory_pct", "memory_pct", False),
    _gpu_panel("temperature", "temperature", False),
    _gpu_panel("power", "power", False),
    _gpu_panel("utilisation_over_time", "util_pct", True),
    _gpu_panel("memory_used", "mem_used", True),
    _gpu_panel("memory_free", "mem_free", True),
    _gpu_panel("temperature_over_time", "temperature", True),
    _gpu_panel("power_over_time", "power", True),
]


@query("dash_gpu", dashboard_sql(GPU, _GPU_CTES))
def dash_gpu(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(GPU, gpu_base(spark, sf))


# --- cost ---------------------------------------------------------------------


def cost_base(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Customers as workloads of a namespace (segment) on a node (nation)."""
    prices = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("namespace"),
        F.col("c_nationkey").alias("node"),
        (F.col("c_acctbal") / 1000).alias("hourly_usd"),
    )
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.sum("o_totalprice") / 1e6).alias("used")
    )
    usage = (
        table(spark, sf, "customer")
        .join(spent, "c_custkey")
        .groupBy(F.col("c_mktsegment").alias("namespace"), F.col("c_nationkey").alias("node"))
        .agg(F.sum("used").alias("used"), F.count(F.lit(1)).cast("double").alias("requested"))
    )
    nodes = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("node"), ((F.col("n_nationkey") + 1) * 0.05).alias("price")
    )
    return {
        "prices": prices,
        "usage": series.record(usage, "usage"),
        "nodes": nodes,
        "devices": records.devices(spark, sf),
        "gpu_time": gpu_base(spark, sf)["time"],
    }


_COST_CTES = f"""{records._DEVICES}, {_GPU_CTES},
pr AS (SELECT c_mktsegment AS namespace, c_nationkey AS node, c_acctbal / 1000 AS h FROM customer),
sp1 AS (SELECT o_custkey, sum(o_totalprice) / 1e6 AS used FROM orders GROUP BY 1),
ug AS (SELECT c_mktsegment AS namespace, c_nationkey AS node, sum(used) AS used, count(*)::DOUBLE AS requested FROM customer JOIN sp1 ON c_custkey = o_custkey GROUP BY 1, 2)"""


def _cost_panel(name: str, by: list[str], monthly: bool) -> Panel:
    column = "monthly_usd" if monthly else "hourly_usd"
    factor = cost.HOURS_PER_MONTH if monthly else 1
    label = by[0] if by else None
    return Panel(
        name,
        lambda b: rows(
            cost.hourly_and_monthly(b["prices"], by),
            F.col(label).cast("string") if label else None,
            None,
            F.round(column, 2),
        ),
        f"SELECT {label or 'NULL'} AS series, NULL AS ts, round(sum(h) * {factor}, 2) AS value FROM pr"
        + (f" GROUP BY {label}" if label else ""),
    )


def _waste_panel(name: str, scale: float) -> Panel:
    def build(b: dict[str, DataFrame]) -> DataFrame:
        scaled = b["usage"].withColumns(
            {"requested": F.col("requested") / scale, "used": F.col("used") / scale}
        )
        waste = cost.overprovisioning_cost(scaled, b["nodes"], "requested", "used", "price")
        return rows(waste, "namespace", None, F.round("waste_usd", 4))

    return Panel(
        name,
        build,
        f"SELECT namespace AS series, NULL AS ts, round(sum((requested / {scale} - used / {scale}) * (node + 1) * 0.05::DOUBLE), 4) AS value FROM ug GROUP BY 1",
    )


def _efficiency_panel(name: str, used: str, available: str) -> Panel:
    return Panel(
        name,
        lambda b: rows(cost.efficiency(b["usage"], [], used, available), None, None, F.col("efficiency")),
        f"SELECT NULL AS series, NULL AS ts, sum({used}) / sum({available}) AS value FROM ug",
    )


COST = [
    _cost_panel("monthly", [], True),
    _cost_panel("hourly", [], False),
    _efficiency_panel("cpu_efficiency", "used", "requested"),
    _efficiency_panel("memory_efficiency", "requested", "used"),
    _cost_panel("monthly_by_namespace", ["namespace"], True),
    _cost_panel("hourly_by_namespace", ["namespace"], False),
    _cost_panel("monthly_per_node", ["node"], True),
    Panel(
        "node_table",
        lambda b: rows(b["nodes"], F.col("node").cast("string"), None, F.col("price")),
        "SELECT n_nationkey AS series, NULL AS ts, (n_nationkey + 1) * 0.05::DOUBLE AS value FROM nation",
    ),
    Panel(
        "gpu_utilisation",
        lambda b: rows(cost.gpu_monthly(b["devices"], ["namespace"]), "namespace", None, F.col("gpu_util")),
        "SELECT namespace AS series, NULL AS ts, avg(gpu_util_pct) / 100 AS value FROM dev GROUP BY 1",
    ),
    Panel(
        "gpu_monthly",
        lambda b: rows(
            cost.gpu_monthly(b["devices"], []), None, None, F.round("gpu_monthly_usd", 2)
        ),
        "SELECT NULL AS series, NULL AS ts, round(sum(gpu_hourly_usd) * 720, 2) AS value FROM dev",
    ),
    Panel(
        "gpu_over_time",
        lambda b: rows(b["gpu_time"], "device", "ts", F.col("util_pct")),
        "SELECT device AS series, ts, avg(util_pct) AS value FROM g GROUP BY 1, 2",
    ),
    _waste_panel("cpu_waste", 1.0),
    _waste_panel("memory_waste", 1024.0),
]


@query("dash_cost", dashboard_sql(COST, _COST_CTES))
def dash_cost(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(COST, cost_base(spark, sf))


@query(
    "bands",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.08 THEN 'red' WHEN l_discount >= 0.05 THEN 'yellow' ELSE 'green' END AS band FROM lineitem""",
)
def bands(spark: SparkSession, sf: str) -> DataFrame:
    colour = band(F.col("l_discount"), ((0.05, "yellow"), (0.08, "red")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", colour.alias("band"))
