"""Intake, feature views, load tests, registry, inventory, cost and logs.

Tables that the driver does not supply are derived from the given ones by rules
on their keys; the SQL repeats the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import asof, cost, inventory, loadtest, logs, registry
from driftline.plans.registry import at_edge, query, table
from driftline.session import new_shared_path
from driftline.sources import files, intake


def _ts(text: str):
    return F.lit(text).cast("timestamp")


# --- A: intake ----------------------------------------------------------------


@query("csv_round_trip", "SELECT * FROM documents")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes, separators and line breaks, written and read again."""
    path = new_shared_path(spark, "documents-csv")
    files.write_csv(table(spark, sf, "documents"), path)
    return files.read_csv_table(
        spark, path, "doc_id long, text string, lang string, source string, n_chars long"
    )


@query(
    "feature_source",
    "SELECT event_id, ts, value FROM events",
)
def feature_source(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = files.read_feature_source(spark, f"{sf}/events.parquet", "ts")
    return at_edge(source.select("event_id", "ts", "value"))


@query(
    "features_round_trip",
    "SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) AS net_quantity FROM lineitem",
)
def features_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "features")
    net = (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("net_quantity")
    files.write_features(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", net), path)
    return spark.read.parquet(path)


@query(
    "json_report",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
)
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "report")
    report = table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")
    )
    files.write_json_report(report, path)
    return spark.read.schema(report.schema).json(path)


@query(
    "url_validity",
    r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN replace(url, 'http', 'ftp')
        WHEN page_id % 11 = 0 THEN regexp_replace(url, '^[a-z]+://', '') ELSE url END AS url FROM pages),
    v AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s,
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS h FROM u)
    SELECT page_id, url, s <> '' AND h <> '' AND s IN ('http', 'https') AS valid,
      CASE WHEN s = '' OR h = '' THEN 'invalid format' WHEN s NOT IN ('http', 'https') THEN 'unsupported scheme' END AS reason
    FROM v""",
)
def url_validity(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("page_id")
    url = (
        F.when(key % 7 == 0, F.replace(F.col("url"), F.lit("http"), F.lit("ftp")))
        .when(key % 11 == 0, F.regexp_replace("url", "^[a-z]+://", ""))
        .otherwise(F.col("url"))
    )
    return intake.check_urls(table(spark, sf, "pages").select("page_id", url.alias("url")), "url")


@query("valid_urls", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://[^/?#]')")
def valid_urls(spark: SparkSession, sf: str) -> DataFrame:
    return intake.valid_source_urls(table(spark, sf, "pages").select("page_id", "url"), "url")


@query(
    "detect_encoding",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-8'
        WHEN regexp_matches(text, '[\x{80}-\x{ff}]') THEN 'cp1252' ELSE 'utf-8' END AS encoding
    FROM documents""",
)
def detect_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as bytes, every other one in ISO-8859-1."""
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.encode(F.regexp_replace("text", "[^\\x{00}-\\x{ff}]", "?"), "ISO-8859-1")
    )
    documents = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return documents.select("doc_id", files.encoding_of(F.col("content")).alias("encoding"))


@query(
    "file_encodings",
    r"""SELECT source, doc_id % 2 AS kind, CASE WHEN doc_id % 2 = 1 AND bool_or(regexp_matches(text, '[\x{80}-\x{ff}]')) THEN 'cp1252'
        ELSE 'utf-8' END AS encoding FROM documents GROUP BY source, doc_id % 2""",
)
def file_encodings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files in two encodings per source, judged folder by folder."""
    path = new_shared_path(spark, "encoded")
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(
        F.encode(F.regexp_replace("text", "[^\\x{00}-\\x{ff}]", "?"), "ISO-8859-1")
    )
    documents = table(spark, sf, "documents").select(
        content.cast("string").alias("value"), "source", (F.col("doc_id") % 2).alias("kind")
    )
    documents.write.partitionBy("source", "kind").text(path)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)", 1)
    return files.detect_encoding(spark, path, folders=True).select(
        part("source").alias("source"), part("kind").cast("long").alias("kind"), "encoding"
    )


@query(
    "file_line_counts",
    """SELECT source, sum(len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS lines, true AS enough
    FROM documents GROUP BY source""",
)
def file_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One text file per source and task, counted file by file, shown by source."""
    path = new_shared_path(spark, "texts")
    documents = table(spark, sf, "documents").select("text", "source")
    documents.write.partitionBy("source").text(path)
    counted = files.line_counts(spark, path)
    return counted.groupBy(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source")).agg(
        F.sum("lines").alias("lines"), F.bool_and("enough").alias("enough")
    )


@query(
    "cached_steps",
    """WITH s AS (SELECT page_id, sha256(url || '|quality') AS key FROM pages),
    m AS (SELECT sha256(url || '|quality') AS key, 'out/' || min(page_id) AS output,
        max(TIMESTAMP '2024-01-31' - to_hours((page_id % 48)::INT)) AS created_at FROM pages WHERE url LIKE 'https:%' GROUP BY 1)
    SELECT page_id, key, CASE WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at) <= 86400000000 THEN output END AS output,
      coalesce(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at) <= 86400000000, false) AS reuse
    FROM s LEFT JOIN m USING (key)""",
)
def cached_steps(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    key = intake.step_key(F.col("url"), F.lit("quality")).alias("key")
    as_of = _ts("2024-01-31")
    hours = (F.col("page_id") % 48) * 3_600_000_000
    kept = (
        pages.filter(F.col("url").startswith("https:"))
        .select(key, "page_id", F.timestamp_micros(F.unix_micros(as_of) - hours).alias("at"))
        .groupBy("key")
        .agg(
            F.concat(F.lit("out/"), F.min("page_id").cast("string")).alias("output"),
            F.max("at").alias("created_at"),
        )
    )
    return intake.reusable_steps(pages.select("page_id", key), kept, as_of)


def _shown(column: str) -> str:
    return f"coalesce(len({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_ORDER_TEXT = " || ".join(
    _shown(c)
    for c in ("o_custkey", "epoch_us(o_orderdate)", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
)


@query(
    "dataset_fingerprint",
    f"""WITH d AS (SELECT sha256({_ORDER_TEXT}) AS d FROM orders)
    SELECT count(*) AS rows, bit_xor(('0x' || d[1:15])::BIGINT) AS hash_xor,
      sum(('0x' || d[16:30])::BIGINT)::VARCHAR AS hash_sum FROM d""",
)
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return intake.dataset_fingerprint(table(spark, sf, "orders"))


@query(
    "dataset_diff",
    """WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 77 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
      FROM orders WHERE o_orderkey % 50 <> 0),
    a AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders)
    SELECT 'removed' AS change, count(*) AS copies, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
    UNION ALL SELECT 'added', count(*), * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""",
)
def dataset_diff(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    new = old.filter(key % 50 != 0).withColumn(
        "o_totalprice", F.when(key % 77 == 0, price + 1).otherwise(price)
    )
    return intake.dataset_diff(old, new)


@query(
    "json_event_filter",
    "SELECT event_id, event_type, props FROM events WHERE json_extract_string(props, '$.k') = '42'",
)
def json_event_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = intake.json_event_filter(table(spark, sf, "events"), "props", "$.k", "42")
    return kept.select("event_id", "event_type", "props")


@query(
    "relabel",
    """SELECT event_id, event_type, 'user-' || user_id AS instance, regexp_replace(props, '[^0-9]', '', 'g') || ':8082' AS address,
      'driftline' AS platform FROM events WHERE event_type IN ('click', 'view')""",
)
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        intake.Rule(("event_type",), "click|view", "keep"),
        intake.Rule(("user_id",), "(.+)", target="instance", replacement="user-$1"),
        intake.Rule(("props",), r'\{"k": (\d+)\}', target="address", replacement="$1:8082"),
    ]
    labelled = intake.relabel(table(spark, sf, "events"), rules)
    return files.tag_static(labelled, {"platform": "driftline"}).select(
        "event_id", "event_type", "instance", "address", "platform"
    )


# --- F: feature views ---------------------------------------------------------

CLICKS = asof.FeatureView(
    "clicks",
    ("user_id",),
    {"click_value": "double", "click_id": "long"},
    timestamp="ts",
    tie=("click_id",),
)


def _clicks(spark: SparkSession, sf: str) -> DataFrame:
    clicks = table(spark, sf, "events").filter("event_type = 'click'")
    return clicks.select(
        "user_id", "ts", F.col("value").alias("click_value"), F.col("event_id").alias("click_id")
    )


@query(
    "asof_features",
    """WITH p AS (SELECT event_id, user_id, ts AS event_timestamp FROM events WHERE event_type = 'purchase'),
    c AS (SELECT user_id, ts, value AS click_value, event_id AS click_id FROM events WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, p.event_timestamp,
      CASE WHEN p.event_timestamp - c.ts <= INTERVAL 7 DAYS THEN c.click_value END AS click_value,
      CASE WHEN p.event_timestamp - c.ts <= INTERVAL 7 DAYS THEN c.click_id END AS click_id
    FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.event_timestamp >= c.ts""",
)
def asof_features(spark: SparkSession, sf: str) -> DataFrame:
    purchases = table(spark, sf, "events").filter("event_type = 'purchase'")
    entities = purchases.select("event_id", "user_id", F.col("ts").alias("event_timestamp"))
    return at_edge(
        asof.historical_features(
            entities, [(CLICKS, _clicks(spark, sf))], ["clicks:click_value", "clicks:click_id"]
        )
    )


@query(
    "latest_features",
    """SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS click_value,
      arg_max(event_id, (ts, event_id)) AS click_id FROM events WHERE event_type = 'click' GROUP BY user_id""",
)
def latest_features(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(asof.online_features(CLICKS, _clicks(spark, sf)))


@query(
    "online_lookup",
    """WITH k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
    c AS (SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS click_value FROM events
      WHERE event_type = 'click' AND ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-13' GROUP BY user_id)
    SELECT user_id, ts, click_value FROM k LEFT JOIN c USING (user_id)""",
)
def online_lookup(spark: SparkSession, sf: str) -> DataFrame:
    buyers = table(spark, sf, "events").filter("event_type = 'purchase'").select("user_id")
    return at_edge(
        asof.online_features(
            CLICKS, _clicks(spark, sf), ["clicks:click_value"], buyers, _ts("2024-01-20")
        )
    )


# --- N: load tests ------------------------------------------------------------

_RESULTS = """r AS (SELECT event_type AS concurrency, event_id, ts, value / 1000 AS ttft_s, value / 100 AS total_s,
  event_id % 200 AS output_tokens, user_id % 10 <> 0 AS ok,
  CASE WHEN user_id % 10 = 0 THEN 'timeout of request ' || event_id END AS error FROM events),
w AS (SELECT concurrency, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall_s FROM r GROUP BY 1)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("user_id") % 10 != 0
    return table(spark, sf, "events").select(
        F.col("event_type").alias("concurrency"),
        "event_id",
        "ts",
        (F.col("value") / 1000).alias("ttft_s"),
        (F.col("value") / 100).alias("total_s"),
        (F.col("event_id") % 200).alias("output_tokens"),
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("timeout of request "), F.col("event_id").cast("string"))).alias(
            "error"
        ),
    )


def _walls(results: DataFrame) -> DataFrame:
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    return results.groupBy("concurrency").agg((span / F.lit(1e6)).alias("wall_s"))


def _nearest(value: str, pct: float) -> str:
    return (
        f"list_sort(list({value}) FILTER (ok AND {value} IS NOT NULL))"
        f"[1 + round_even({pct}::DOUBLE / 100 * (count({value}) FILTER (ok) - 1), 0)::BIGINT]"
    )


_SUMMARY = f"""{_RESULTS},
x AS (SELECT *, CASE WHEN total_s > 0 AND output_tokens > 0 THEN output_tokens / total_s END AS rate FROM r),
s AS (SELECT concurrency, count(*) AS requests, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS errors,
  round({_nearest('ttft_s', 50)}, 3) AS ttft_p50_s, round({_nearest('ttft_s', 95)}, 3) AS ttft_p95_s,
  round({_nearest('total_s', 50)}, 3) AS latency_p50_s, round({_nearest('total_s', 95)}, 3) AS latency_p95_s,
  round({_nearest('rate', 50)}, 1) AS per_request_tokens_per_s_median,
  (sum(output_tokens) FILTER (ok))::BIGINT AS total_output_tokens FROM x GROUP BY concurrency),
summary AS (SELECT s.*, round(total_output_tokens / wall_s, 1) AS aggregate_tokens_per_s, round(wall_s, 1) AS wall_clock_s
  FROM s JOIN w USING (concurrency))"""


@query(
    "percentile_nearest_rank",
    f"""WITH {_RESULTS} SELECT concurrency, count(*) AS n, {_nearest('total_s', 50).replace('ok AND ', '').replace(' FILTER (ok)', '')} AS p_50,
    {_nearest('total_s', 99).replace('ok AND ', '').replace(' FILTER (ok)', '')} AS p_99 FROM r GROUP BY 1""",
)
def percentile_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return loadtest.percentile_nearest_rank(_results(spark, sf), ["concurrency"], "total_s", [50, 99])


@query("bench_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    return loadtest.benchmark_summary(results, _walls(results))


@query(
    "cost_per_mtok",
    f"""WITH {_SUMMARY} SELECT concurrency, CASE WHEN aggregate_tokens_per_s > 0
      THEN round(0.77::DOUBLE / (aggregate_tokens_per_s * 3600 / 1000000), 3) ELSE 0 END AS cost_per_mtok_usd FROM summary""",
)
def cost_per_mtok(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    summary = loadtest.benchmark_summary(results, _walls(results))
    price = loadtest.cost_per_mtok(F.col("aggregate_tokens_per_s"), 0.77)
    return summary.select("concurrency", price.alias("cost_per_mtok_usd"))


@query(
    "bench_report",
    f"""WITH {_SUMMARY} SELECT concurrency, '| ' || concurrency || ' | ' || ok || '/' || errors || ' | ' || ttft_p50_s || 's | '
      || ttft_p95_s || 's | ' || latency_p50_s || 's | ' || latency_p95_s || 's | ' || per_request_tokens_per_s_median || ' | '
      || aggregate_tokens_per_s || ' | ' || CASE WHEN aggregate_tokens_per_s > 0
        THEN round(0.77::DOUBLE / (aggregate_tokens_per_s * 3600 / 1000000), 3) ELSE 0.0::DOUBLE END || ' |' AS line FROM summary""",
)
def bench_report(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    return loadtest.report_lines(loadtest.benchmark_summary(results, _walls(results)), 0.77)


@query(
    "p95_floor_index",
    f"""WITH {_RESULTS} SELECT concurrency, count(*) AS n, round(avg(total_s), 4) AS mean,
      round(list_sort(list(total_s))[1 + least(floor(0.95::DOUBLE * count(*)), count(*) - 1)::BIGINT], 4) AS p95
    FROM r GROUP BY 1""",
)
def p95_floor_index(spark: SparkSession, sf: str) -> DataFrame:
    return loadtest.p95_floor_index(_results(spark, sf), ["concurrency"], "total_s")


@query(
    "first_errors",
    f"WITH {_RESULTS} SELECT concurrency, arg_min(error, event_id) AS first_error FROM r WHERE error IS NOT NULL GROUP BY 1",
)
def first_errors(spark: SparkSession, sf: str) -> DataFrame:
    return loadtest.first_errors(_results(spark, sf), "concurrency", "event_id")


# --- K: registry and governance -----------------------------------------------

_RUNS = """runs AS (SELECT p_brand AS model, p_partkey AS run_id, TIMESTAMP '2024-01-01' + to_minutes(p_partkey % 5000) AS ts,
  CASE WHEN p_partkey % 17 <> 0 THEN p_size * 2 / 100.0::DOUBLE END AS accuracy, p_type AS experiment_id,
  CASE p_partkey % 4 WHEN 0 THEN 's3://models/' WHEN 1 THEN 'gs://models/' WHEN 2 THEN 'artifacts:/' ELSE 'https://models/' END || p_partkey AS source
  FROM part)"""


def runs_table(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    minutes = (key % 5000) * 60_000_000
    accuracy = F.when(key % 17 != 0, F.create_map(F.lit("accuracy"), F.col("p_size") * 2 / F.lit(100.0)))
    place = (
        F.when(key % 4 == 0, "s3://models/")
        .when(key % 4 == 1, "gs://models/")
        .when(key % 4 == 2, "artifacts:/")
        .otherwise("https://models/")
    )
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("model"),
        key.alias("run_id"),
        F.timestamp_micros(F.unix_micros(_ts("2024-01-01")) + minutes).alias("ts"),
        F.coalesce(accuracy, F.create_map(F.lit("loss"), F.lit(0.5))).alias("metrics"),
        F.col("p_type").alias("experiment_id"),
        F.concat(place, key.cast("string")).alias("source"),
    )


_VERSIONS = f"""{_RUNS}, versions AS (SELECT model, run_id, ts, source,
  row_number() OVER (PARTITION BY model ORDER BY ts, run_id) AS version FROM runs WHERE accuracy >= 0.6)"""


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    registered = registry.registration_gate(runs_table(spark, sf), 0.6).filter(
        "decision = 'registered'"
    )
    return registry.assign_versions(registered.select("model", "run_id", "ts", "source"))


@query(
    "registry_gate",
    f"""WITH {_RUNS} SELECT model, run_id, accuracy AS value, CASE WHEN accuracy IS NULL THEN 'missing_metric'
      WHEN accuracy >= 0.6 THEN 'registered' ELSE 'below_threshold' END AS decision FROM runs""",
)
def registry_gate(spark: SparkSession, sf: str) -> DataFrame:
    return registry.registration_gate(runs_table(spark, sf), 0.6).select(
        "model", "run_id", "value", "decision"
    )


@query("assign_versions", f"WITH {_VERSIONS} SELECT * FROM versions")
def assign_versions(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(_versions(spark, sf))


@query(
    "resolve_alias",
    f"""WITH {_VERSIONS}, newest AS (SELECT * FROM versions QUALIFY version = max(version) OVER (PARTITION BY model))
    SELECT n.model, 'champion' AS alias, version, n.run_id::VARCHAR AS run_id,
      coalesce(r.experiment_id, '') AS experiment_id, n.source AS storage_uri,
      CASE WHEN regexp_matches(n.source, '^(s3|gs|abs|https|http|pvc)://') THEN 'resolved' ELSE 'unfetchable' END AS status
    FROM newest n LEFT JOIN (SELECT * FROM runs WHERE experiment_id <> 'PROMO') r ON n.run_id = r.run_id""",
)
def resolve_alias(spark: SparkSession, sf: str) -> DataFrame:
    versions = _versions(spark, sf).withColumn("run_id", F.col("run_id").cast("string"))
    known = runs_table(spark, sf).filter(F.col("experiment_id") != "PROMO")
    runs = known.withColumn("run_id", F.col("run_id").cast("string"))
    return registry.resolve_alias(registry.assign_alias(versions, "champion"), versions, runs)


_DEPLOYMENTS = """d AS (SELECT s_name AS name, s_suppkey AS k,
  CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS model_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '3' WHEN 2 THEN '1.0.2' WHEN 4 THEN '10' END AS model_version,
  CASE WHEN s_suppkey % 11 <> 0 THEN 'team-' || s_nationkey END AS model_owner,
  CASE s_suppkey % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'staging' WHEN 2 THEN 'archived' ELSE 'dev' END AS model_stage
  FROM supplier)"""


def deployments(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    labels = {
        "model-name": F.when(key % 7 != 0, F.col("s_name")),
        "model-version": F.when(key % 5 == 0, "abc")
        .when(key % 5 == 1, "3")
        .when(key % 5 == 2, "1.0.2")
        .when(key % 5 == 4, "10"),
        "model-owner": F.when(
            key % 11 != 0, F.concat(F.lit("team-"), F.col("s_nationkey").cast("string"))
        ),
        "model-stage": F.when(key % 4 == 0, "production")
        .when(key % 4 == 1, "staging")
        .when(key % 4 == 2, "archived")
        .otherwise("dev"),
    }
    notes = {
        "approved-by": F.when(key % 3 != 0, "lead"),
        "approval-date": F.lit("2024-01-01"),
        "approval-ticket": F.when(key % 13 != 0, "T-1"),
        "experiment-id": F.when(key % 6 != 0, "1"),
        "run-id": F.col("s_name"),
        "accuracy": F.when(key % 8 != 0, "0.9"),
        "f1-score": F.when(key % 16 == 0, "0.8"),
    }

    def filled(entries: dict):
        pairs = [c for k, v in entries.items() for c in (F.lit(k), v)]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), filled(labels).alias("labels"), filled(notes).alias("annotations")
    )


@query(
    "policy_results",
    f"""WITH {_DEPLOYMENTS}
    SELECT name, 'require-model-labels' AS rule, CASE WHEN model_name IS NOT NULL AND model_version IS NOT NULL AND model_owner IS NOT NULL AND model_stage <> 'dev' THEN 'pass' ELSE 'fail' END AS result FROM d
    UNION ALL SELECT name, 'require-approval-for-production', CASE WHEN model_stage <> 'production' THEN 'skip' WHEN k % 3 <> 0 AND k % 13 <> 0 THEN 'pass' ELSE 'fail' END FROM d
    UNION ALL SELECT name, 'require-lineage', CASE WHEN k % 6 <> 0 THEN 'pass' ELSE 'fail' END FROM d
    UNION ALL SELECT name, 'require-performance-metrics', CASE WHEN model_stage <> 'production' THEN 'skip' WHEN k % 8 <> 0 OR k % 16 = 0 THEN 'pass' ELSE 'fail' END FROM d
    UNION ALL SELECT name, 'validate-version-format', CASE WHEN coalesce(model_version, '0') = 'abc' THEN 'fail' ELSE 'pass' END FROM d""",
)
def policy_results(spark: SparkSession, sf: str) -> DataFrame:
    return registry.policy_results(deployments(spark, sf))


_CHANGES = """c AS (SELECT 'model-' || o_custkey AS name, o_orderdate AS ts, o_orderpriority AS username,
  CASE o_orderkey % 3 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS operation,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'model-' || o_custkey END AS model_name, (o_orderkey % 9)::VARCHAR AS model_version,
  CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'staging' END AS model_stage, o_orderkey FROM orders)"""


def changes_table(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.lit("model-"), F.col("o_custkey").cast("string"))
    stage = F.when(F.col("o_orderstatus") == "F", "production").when(
        F.col("o_orderstatus") == "O", "staging"
    )
    labels = F.map_filter(
        F.create_map(
            F.lit("model-name"),
            F.when(key % 4 != 0, name),
            F.lit("model-version"),
            (key % 9).cast("string"),
            F.lit("model-stage"),
            stage,
        ),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, sf, "orders").select(
        name.alias("name"),
        "o_orderkey",
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("username"),
        F.when(key % 3 == 0, "CREATE").when(key % 3 == 1, "UPDATE").otherwise("DELETE").alias(
            "operation"
        ),
        labels.alias("labels"),
    )


@query(
    "audit_log",
    f"""WITH {_CHANGES} SELECT name, coalesce(model_name, 'unknown') AS model_name, model_version, 'unknown' AS model_owner,
      coalesce(model_stage, 'unknown') AS model_stage, username AS deployed_by, ts AS deployed_at, operation
    FROM c WHERE operation <> 'DELETE'""",
)
def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(registry.audit_log(changes_table(spark, sf)))


@query(
    "denied_deletes",
    f"WITH {_CHANGES} SELECT o_orderkey, name FROM c WHERE operation = 'DELETE' AND model_stage = 'production'",
)
def denied_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return registry.denied_deletes(changes_table(spark, sf)).select("o_orderkey", "name")


_IMAGES = """i AS (SELECT p_partkey, 'registry.local/' || p_type || CASE p_partkey % 3 WHEN 0 THEN ':latest' WHEN 1 THEN ':1.2' ELSE ':main' END AS image FROM part
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'docker.io/init:latest' ELSE 'registry.local/init:2' END FROM part)"""


def _pods_with_images(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    tag = F.when(key % 3 == 0, ":latest").when(key % 3 == 1, ":1.2").otherwise(":main")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array(F.concat(F.lit("registry.local/"), F.col("p_type"), tag)).alias("containers"),
        F.array(
            F.when(key % 5 == 0, "docker.io/init:latest").otherwise("registry.local/init:2")
        ).alias("init_containers"),
    )


@query(
    "mutable_images",
    f"WITH {_IMAGES} SELECT p_partkey, image FROM i WHERE suffix(image, ':latest') OR suffix(image, ':main')",
)
def mutable_images(spark: SparkSession, sf: str) -> DataFrame:
    return registry.mutable_images(_pods_with_images(spark, sf), ["p_partkey"])


@query(
    "external_images",
    f"WITH {_IMAGES} SELECT p_partkey, image FROM i WHERE NOT starts_with(image, 'registry.local/')",
)
def external_images(spark: SparkSession, sf: str) -> DataFrame:
    return registry.external_images(_pods_with_images(spark, sf), ["p_partkey"], "registry.local/")


@query(
    "supply_chain",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'rejected: no revision'
      WHEN p_partkey % 4 = 0 THEN 'rejected: unsafe weights' ELSE 'accepted' END AS verdict FROM part""",
)
def supply_chain(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    artifacts = table(spark, sf, "part").select(
        "p_partkey",
        F.when(key % 6 != 0, F.col("p_name")).alias("revision"),
        F.array(
            F.lit("model.safetensors"), F.when(key % 4 == 0, "weights.bin").otherwise("config.json")
        ).alias("files"),
    )
    return registry.supply_chain(artifacts).select("p_partkey", "verdict")


# --- L: inventory -------------------------------------------------------------

_AS_OF = "1999-01-01"


def _ns(key: str):
    return F.concat(F.lit("ns-"), (F.col(key) % 5).cast("string"))


def _named(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def pods(spark: SparkSession, sf: str) -> DataFrame:
    next_day = F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")
    return table(spark, sf, "orders").select(
        _ns("o_custkey").alias("namespace"),
        _named("pod-", "o_orderkey").alias("name"),
        F.when(F.col("o_orderstatus") == "F", "Succeeded").otherwise("Running").alias("phase"),
        F.array(
            F.struct(F.col("o_orderdate").alias("last_transition")),
            F.struct(next_day.alias("last_transition")),
        ).alias("conditions"),
        F.array(F.struct((F.col("o_orderkey") % 3).alias("restarts"))).alias("containers"),
        F.when(F.col("o_orderstatus") == "P", F.array(_named("claim-", "o_custkey"))).alias("claims"),
    )


def claims(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.when(F.col("c_custkey") % 3 == 0, "Ti").otherwise("Gi")
    return table(spark, sf, "customer").select(
        _ns("c_custkey").alias("namespace"),
        _named("claim-", "c_custkey").alias("name"),
        F.concat((F.col("c_custkey") % 50).cast("string"), unit).alias("storage"),
    )


def replica_table(spark: SparkSession, sf: str) -> DataFrame:
    replicas = F.col("p_size") % 6
    return table(spark, sf, "part").select(
        _ns("p_partkey").alias("namespace"),
        _named("deploy-", "p_partkey").alias("name"),
        F.when(replicas > 0, replicas).alias("replicas"),
        F.when(F.col("p_partkey") % 3 != 0, replicas).alias("ready_replicas"),
    )


def services(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        _ns("s_suppkey").alias("namespace"), _named("svc-", "s_suppkey").alias("name")
    )


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose number of lines is not a multiple of three."""
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").count().filter("count % 3 <> 0")
    return lines.select(
        _ns("l_suppkey").alias("namespace"), _named("svc-", "l_suppkey").alias("name")
    )


def inference_services(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("n_nationkey") % 3 == 0, "True").otherwise("False")
    return table(spark, sf, "nation").select(
        F.lit("models").alias("namespace"),
        F.col("n_name").alias("name"),
        F.array(F.struct(F.lit("Ready").alias("type"), status.alias("status"))).alias("conditions"),
    )


_FIND = """pods AS (SELECT 'ns-' || (o_custkey % 5) AS namespace, 'pod-' || o_orderkey AS name, o_orderstatus <> 'F' AS running,
  o_orderdate + INTERVAL 1 DAY AS last, o_orderkey % 3 AS restarts, o_custkey FROM orders),
fi AS (
  SELECT 'idle_pod' AS type, 'low' AS severity, namespace || '/' || name AS resource,
    (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(last)) / 3600000000.0 AS age_hours, NULL::BIGINT AS replicas, NULL::VARCHAR AS storage
  FROM pods WHERE running AND restarts = 0 AND epoch_us(TIMESTAMP '1999-01-01') - epoch_us(last) > 24 * 3600000000
  UNION ALL SELECT 'overprovisioned_deployment', 'medium', 'ns-' || (p_partkey % 5) || '/deploy-' || p_partkey, NULL, p_size % 6, NULL
  FROM part WHERE p_size % 6 >= 3 AND p_partkey % 3 <> 0
  UNION ALL SELECT 'orphaned_volume', 'high', 'ns-' || (c_custkey % 5) || '/claim-' || c_custkey, NULL, NULL,
    (c_custkey % 50) || CASE WHEN c_custkey % 3 = 0 THEN 'Ti' ELSE 'Gi' END
  FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT 'service_no_endpoints', 'medium', 'ns-' || (s_suppkey % 5) || '/svc-' || s_suppkey, NULL, NULL, NULL
  FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) % 3 <> 0)
  UNION ALL SELECT 'inference_service_review', 'info', 'models/' || n_name, NULL, NULL, NULL FROM nation WHERE n_nationkey % 3 = 0)"""


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.findings(
        inventory.idle_pods(pods(spark, sf), _ts(_AS_OF)),
        inventory.overprovisioned(replica_table(spark, sf)),
        inventory.orphaned_volumes(claims(spark, sf), pods(spark, sf)),
        inventory.services_without_endpoints(services(spark, sf), endpoints(spark, sf)),
        inventory.ready_services(inference_services(spark, sf)),
    )


@query(
    "idle_pods",
    f"WITH {_FIND} SELECT type, severity, resource, round(age_hours, 6) AS age_hours FROM fi WHERE type = 'idle_pod'",
)
def idle_pods(spark: SparkSession, sf: str) -> DataFrame:
    found = inventory.idle_pods(pods(spark, sf), _ts(_AS_OF))
    return at_edge(found.select("type", "severity", "resource", "age_hours"))


@query(
    "overprovisioned",
    f"WITH {_FIND} SELECT resource, severity, replicas FROM fi WHERE type = 'overprovisioned_deployment'",
)
def overprovisioned(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.overprovisioned(replica_table(spark, sf)).select(
        "resource", "severity", "replicas"
    )


@query(
    "orphaned_volumes",
    f"WITH {_FIND} SELECT resource, severity, storage FROM fi WHERE type = 'orphaned_volume'",
)
def orphaned_volumes(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.orphaned_volumes(claims(spark, sf), pods(spark, sf)).select(
        "resource", "severity", "storage"
    )


@query(
    "services_without_endpoints",
    f"WITH {_FIND} SELECT resource, severity FROM fi WHERE type = 'service_no_endpoints'",
)
def services_without_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.services_without_endpoints(services(spark, sf), endpoints(spark, sf)).select(
        "resource", "severity"
    )


@query(
    "ready_services",
    f"WITH {_FIND} SELECT resource, severity FROM fi WHERE type = 'inference_service_review'",
)
def ready_services(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.ready_services(inference_services(spark, sf)).select("resource", "severity")


@query(
    "idle_report",
    f"""WITH {_FIND} SELECT s.severity, count(type) AS findings
    FROM (VALUES ('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN fi USING (severity) GROUP BY 1""",
)
def idle_report(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.severity_counts(_findings(spark, sf))


@query(
    "savings",
    f"""WITH {_FIND} SELECT round(sum(CASE WHEN type = 'orphaned_volume' AND suffix(storage, 'Gi') THEN replace(storage, 'Gi', '')::INT * 0.1
      WHEN type = 'overprovisioned_deployment' THEN (replicas - 2) * 30 ELSE 0 END), 2)::DOUBLE AS monthly_savings_usd FROM fi""",
)
def savings(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.savings(_findings(spark, sf))


# --- M: cost ------------------------------------------------------------------


def spend(spark: SparkSession, sf: str) -> DataFrame:
    """Cost per day and nation: lines with their order, customer and nation.

    Lines are summed per order and day, then per customer and day, before each
    join: an order or customer with very many lines is a few rows by then.
    """
    items = table(spark, sf, "lineitem").groupBy(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("day")
    ).agg(
        F.sum("l_extendedprice").alias("unblended"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("blended"),
        F.sum("l_quantity").alias("usage"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
        .groupBy("o_custkey", "day")
        .agg(*[F.sum(c).alias(c) for c in ("unblended", "blended", "usage")])
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("service"))
    return (
        per_customer.join(customers, per_customer["o_custkey"] == customers["c_custkey"])
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("day", "service", "unblended", "blended", "usage")
    )


_SPEND = """sp AS (SELECT l_shipdate::DATE AS day, n_name AS service, l_extendedprice AS unblended,
  l_extendedprice * (1 - l_discount) AS blended, l_quantity AS usage
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(
    "cost_hourly_monthly",
    """SELECT c_mktsegment AS namespace, c_nationkey AS node, round(sum(c_acctbal / 1000), 4) AS hourly_usd, round(sum(c_acctbal / 1000) * 730, 2) AS monthly_usd
    FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) HAVING grouping(c_nationkey) = 0 OR grouping(c_mktsegment) = 1""",
)
def cost_hourly_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """By namespace and node, and the total."""
    prices = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("namespace"),
        F.col("c_nationkey").alias("node"),
        (F.col("c_acctbal") / 1000).alias("hourly_usd"),
    )
    detail = cost.hourly_and_monthly(prices, ["namespace", "node"])
    total = cost.hourly_and_monthly(prices, []).select(
        F.lit(None).cast("string").alias("namespace"), F.lit(None).cast("int").alias("node"), "*"
    )
    return detail.unionByName(total).select(
        "namespace", "node", F.round("hourly_usd", 4).alias("hourly_usd"), F.round("monthly_usd", 2).alias("monthly_usd")
    )


@query(
    "cost_efficiency",
    "SELECT l_returnflag AS namespace, round(sum(l_quantity) / sum(l_quantity + l_linenumber), 6) AS efficiency FROM lineitem GROUP BY 1",
)
def cost_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    usage = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("namespace"),
        F.col("l_quantity").alias("used"),
        (F.col("l_quantity") + F.col("l_linenumber")).alias("allocatable"),
    )
    return at_edge(cost.efficiency(usage, ["namespace"], "used", "allocatable"))


@query(
    "cost_waste",
    """SELECT o_orderpriority AS namespace, round(sum((o_totalprice / 1e5 - (o_orderkey % 10) / 10.0) * (n_nationkey + 1) * 0.05::DOUBLE), 4) AS waste_usd
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def cost_waste(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("node")
    )
    usage = table(spark, sf, "orders").select(
        "o_custkey",
        F.col("o_orderpriority").alias("namespace"),
        (F.col("o_totalprice") / 1e5).alias("requested"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("used"),
    )
    nodes = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("node"), ((F.col("n_nationkey") + 1) * 0.05).alias("price")
    )
    return at_edge(
        cost.overprovisioning_cost(
            usage.join(customers, "o_custkey"), nodes, "requested", "used", "price"
        ),
        4,
    )


_DEVICES = """dev AS (SELECT l_returnflag AS namespace, l_extendedprice / 1e4 AS gpu_hourly_usd, l_discount * 1000 AS gpu_util_pct,
  l_quantity AS mem_used, 50 - l_quantity AS mem_free, l_tax * 1000 AS temperature, l_quantity * 5 AS power FROM lineitem)"""


def devices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("namespace"),
        (F.col("l_extendedprice") / 1e4).alias("gpu_hourly_usd"),
        (F.col("l_discount") * 1000).alias("gpu_util_pct"),
        F.col("l_quantity").alias("mem_used"),
        (50 - F.col("l_quantity")).alias("mem_free"),
        (F.col("l_tax") * 1000).alias("temperature"),
        (F.col("l_quantity") * 5).alias("power"),
    )


@query(
    "gpu_cost",
    f"""WITH {_DEVICES} SELECT namespace, round(sum(gpu_hourly_usd) * 720, 2) AS gpu_monthly_usd, round(avg(gpu_util_pct) / 100, 6) AS gpu_util
    FROM dev GROUP BY 1""",
)
def gpu_cost(spark: SparkSession, sf: str) -> DataFrame:
    found = cost.gpu_monthly(devices(spark, sf), ["namespace"])
    return at_edge(found.withColumn("gpu_monthly_usd", F.round("gpu_monthly_usd", 2)))


@query(
    "gpu_rollup",
    f"""WITH {_DEVICES} SELECT namespace, round(avg(gpu_util_pct), 6) AS util_pct, round(avg(mem_used / (mem_used + mem_free) * 100), 6) AS memory_pct,
      round(avg(temperature), 6) AS temperature, round(avg(power), 6) AS power, sum(mem_used) AS mem_used, sum(mem_free) AS mem_free
    FROM dev GROUP BY 1""",
)
def gpu_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(cost.gpu_rollup(devices(spark, sf), ["namespace"]))


@query(
    "cost_by_service",
    f"""WITH {_SPEND} SELECT day, service, round(sum(unblended), 4) AS unblended, round(sum(blended), 4) AS blended, sum(usage) AS usage
    FROM sp WHERE day >= DATE '1997-01-01' AND day < DATE '1997-04-01' GROUP BY 1, 2""",
)
def cost_by_service(spark: SparkSession, sf: str) -> DataFrame:
    first, last = F.lit("1997-01-01").cast("date"), F.lit("1997-04-01").cast("date")
    return at_edge(cost.daily_cost(spend(spark, sf), first, last), 4)


@query(
    "cost_monthly",
    f"""WITH {_SPEND} SELECT date_trunc('month', day)::DATE AS month, service, round(sum(unblended), 2) AS unblended
    FROM sp WHERE service IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') GROUP BY 1, 2""",
)
def cost_monthly(spark: SparkSession, sf: str) -> DataFrame:
    four = ["NATION_1", "NATION_2", "NATION_3", "NATION_4"]
    return at_edge(cost.monthly_cost_of(spend(spark, sf), four), 2)


@query(
    "pods_by_namespace",
    """SELECT 'ns-' || (o_custkey % 5) AS namespace, count(*) OVER (PARTITION BY o_custkey % 5) AS pod_count, 'pod-' || o_orderkey AS pod,
      o_totalprice / 1e5 AS cpu_request, (o_orderkey % 8) || 'Gi' AS memory_request FROM orders""",
)
def pods_by_namespace(spark: SparkSession, sf: str) -> DataFrame:
    requested = table(spark, sf, "orders").select(
        _ns("o_custkey").alias("namespace"),
        _named("pod-", "o_orderkey").alias("pod"),
        (F.col("o_totalprice") / 1e5).alias("cpu_request"),
        F.concat((F.col("o_orderkey") % 8).cast("string"), F.lit("Gi")).alias("memory_request"),
    )
    return cost.pods_by_namespace(requested)


@query(
    "budget_crossing",
    f"""WITH {_SPEND}, d AS (SELECT service, day, sum(unblended) AS c FROM sp GROUP BY 1, 2),
    b AS (SELECT service, sum(c) * 0.9::DOUBLE AS budget FROM d GROUP BY 1),
    r AS (SELECT service, day, sum(c) OVER (PARTITION BY service ORDER BY day) AS spent FROM d)
    SELECT service, share, min(day) AS day, round(arg_min(spent, day), 2) AS spent
    FROM r JOIN b USING (service), (VALUES (0.5::DOUBLE), (0.8), (1.0)) s(share) WHERE spent >= share * budget GROUP BY 1, 2""",
)
def budget_crossing(spark: SparkSession, sf: str) -> DataFrame:
    costs = spend(spark, sf).groupBy("service", "day").agg(F.sum("unblended").alias("cost"))
    budgets = costs.groupBy("service").agg((F.sum("cost") * 0.9).alias("budget"))
    return at_edge(cost.budget_crossings(costs, budgets, ["service"]), 2)


@query(
    "usage_ratio",
    """SELECT c_nationkey AS namespace, round(u, 2) AS used, round(l, 2) AS "limit", round(u / l, 6) AS ratio FROM
      (SELECT c_nationkey, sum(o_totalprice) AS u FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
      JOIN (SELECT c_nationkey, sum(c_acctbal + 1000) AS l FROM customer GROUP BY 1) USING (c_nationkey)""",
)
def usage_ratio(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_nationkey").alias("namespace"),
        (F.col("c_acctbal") + 1000).alias("limit"),
    )
    # Orders are summed per customer before the join.
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("used")
    )
    usage = spent.join(customers, "c_custkey")
    found = cost.usage_ratio(usage, customers, ["namespace"], "used", "limit")
    return found.select(
        "namespace",
        F.round("used", 2).alias("used"),
        F.round("limit", 2).alias("limit"),
        F.round("ratio", 6).alias("ratio"),
    )


# --- O: logs ------------------------------------------------------------------


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as JSON log lines; every 50th line is cut off."""
    turn = F.col("turn")
    seconds = F.col("conv_id") * 3600 + turn * 60 + F.length("text") % 30
    event = (
        F.when(F.length("text") % 7 == 0, "step_error")
        .when(turn % 2 == 0, "step_start")
        .otherwise("step_complete")
    )
    line = F.to_json(
        F.struct(
            F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
            F.when(event == "step_error", "ERROR").otherwise("INFO").alias("level"),
            F.lit("pipeline").alias("logger"),
            F.col("text").alias("message"),
            F.col("role").alias("service"),
            F.concat(F.lit("run-"), F.col("conv_id").cast("string")).alias("correlation_id"),
            F.struct(F.lit("job.py").alias("file"), turn.alias("line")).alias("location"),
            F.create_map(
                F.lit("event"),
                event,
                F.lit("step"),
                F.concat(F.lit("step-"), F.floor(turn / 2).cast("string")),
                F.lit("error_type"),
                F.concat(F.lit("E"), (F.length("text") % 3).cast("string")),
            ).alias("extra"),
        )
    )
    cut = (F.col("conv_id") + turn) % 50 == 0
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(cut, F.substring(line, 1, 40)).otherwise(line).alias("value")
    )


_LOG = """lg AS (SELECT conv_id, turn, role, text, (conv_id + turn) % 50 = 0 AS bad,
  make_timestamp((conv_id * 3600 + turn * 60 + len(text) % 30) * 1000000) AS ts, 'run-' || conv_id AS run, 'step-' || (turn // 2) AS step,
  CASE WHEN len(text) % 7 = 0 THEN 'step_error' WHEN turn % 2 = 0 THEN 'step_start' ELSE 'step_complete' END AS event,
  'E' || (len(text) % 3) AS error_type FROM conversations),
ok AS (SELECT * FROM lg WHERE NOT bad)"""


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_logs(log_lines(spark, sf), keep=["conv_id", "turn"])


@query(
    "parse_logs",
    f"""WITH {_LOG} SELECT conv_id, turn, CASE WHEN NOT bad THEN ts END AS ts, CASE WHEN NOT bad THEN CASE WHEN event = 'step_error' THEN 'ERROR' ELSE 'INFO' END END AS level,
      CASE WHEN NOT bad THEN text END AS message, CASE WHEN NOT bad THEN role END AS service, CASE WHEN NOT bad THEN run END AS correlation_id,
      CASE WHEN NOT bad THEN turn END AS line, CASE WHEN NOT bad THEN event END AS event, bad AS quarantined FROM lg""",
)
def parse_logs(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _logs(spark, sf)
    good = F.col("quarantine").isNull()
    fields = {
        "ts": F.col("timestamp"),
        "level": F.col("level"),
        "message": F.col("message"),
        "service": F.col("service"),
        "correlation_id": F.col("correlation_id"),
        "line": F.col("location.line"),
        "event": F.element_at("extra", "event"),
    }
    return at_edge(
        parsed.select(
            "conv_id",
            "turn",
            *[F.when(good, c).alias(n) for n, c in fields.items()],
            (~good).alias("quarantined"),
        )
    )


@query(
    "log_traces",
    f"WITH {_LOG} SELECT run AS correlation_id, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (event = 'step_error') AS errors FROM ok GROUP BY 1",
)
def log_traces(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(logs.traces(_logs(spark, sf).filter("quarantine IS NULL")))


@query(
    "log_trace",
    f"WITH {_LOG} SELECT turn, ts AS timestamp, text AS message FROM ok WHERE run = 'run-3'",
)
def log_trace(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(logs.trace(_logs(spark, sf), "run-3").select("turn", "timestamp", "message"))


@query(
    "step_durations",
    f"""WITH {_LOG} SELECT run AS correlation_id, step, min(ts) FILTER (event = 'step_start') AS started, max(ts) FILTER (event = 'step_complete') AS completed,
      round((epoch_us(max(ts) FILTER (event = 'step_complete')) - epoch_us(min(ts) FILTER (event = 'step_start'))) / 1e6, 6) AS seconds
    FROM ok WHERE event <> 'step_error' GROUP BY 1, 2""",
)
def step_durations(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(logs.step_durations(_logs(spark, sf)))


@query(
    "step_errors",
    f"WITH {_LOG} SELECT step, error_type, count(*) AS errors FROM ok WHERE event = 'step_error' GROUP BY 1, 2",
)
def step_errors(spark: SparkSession, sf: str) -> DataFrame:
    return logs.step_errors(_logs(spark, sf))


@query("namespace_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def namespace_filter(spark: SparkSession, sf: str) -> DataFrame:
    return logs.namespace_filter(table(spark, sf, "documents"), ["en", "fr"], "lang").select("doc_id", "lang")


@query(
    "run_status",
    """SELECT user_id % 4 AS shard, date_trunc('day', ts)::TIMESTAMP AS interval_start, count(*) FILTER (event_type = 'purchase') AS succeeded,
      count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS error, count(*) FILTER (event_type IN ('click', 'view')) AS running
    FROM events GROUP BY 1, 2""",
)
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "Succeeded")
        .when(kind == "error", "Failed")
        .when(kind == "signup", "Error")
        .otherwise("Running")
    )
    runs = table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("shard"), "ts", status.alias("status")
    )
    return at_edge(logs.run_status(runs, ["shard"], "status", "ts", "1 day"))


@query(
    "accuracy_trend",
    f"WITH {_RUNS} SELECT model, run_id, ts, accuracy FROM runs WHERE accuracy IS NOT NULL",
)
def accuracy_trend(spark: SparkSession, sf: str) -> DataFrame:
    return at_edge(logs.metric_trend(runs_table(spark, sf), "accuracy"))
