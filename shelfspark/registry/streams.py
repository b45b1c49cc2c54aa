"""Sources and streaming queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import pages as P
from shelfspark.operators import queues as Q
from shelfspark.registry import pages as RP
from shelfspark.registry.base import table
from shelfspark.session import scratch_path
from shelfspark.sources import logs, reports, state
from shelfspark.sources import records as R
from shelfspark.streaming import jobs as J


def _stream(spark, sf, name):
    """The table's files as a file stream; the pattern fits a single file too."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque*")


# ---- sources -------------------------------------------------------------------
def _payloads(spark, sf):
    """Every page's URL in one of the five list shapes, by the form of the URL."""
    url, alt = F.col("url"), F.concat(F.col("url"), F.lit("&b"))
    obj = lambda a, b: F.to_json(F.struct(a, b))
    shape = (
        F.when(url.contains("utm_"), F.concat(F.lit("﻿[1, "), F.to_json(F.array(url, url, F.lit(" "))).substr(F.lit(2), F.lit(2**31 - 1))))
        .when(url.endswith(".html"), F.concat(
            F.lit("["), obj(url.alias("url"), F.lit("  ").alias("product_url")), F.lit(","),
            obj(url.alias("url"), alt.alias("product_url")), F.lit("]")))
        .when(url.contains("?page="), F.concat(
            F.lit('{"results":[7,'), obj(url.alias("url"), alt.alias("product_url")), F.lit("]}")))
        .when(url.endswith("/"), F.concat(F.lit('{"urls":'), F.to_json(F.array(alt, url)), F.lit("}")))
        .otherwise(F.concat(F.lit("﻿  "), url, F.lit("\r\n\n"), alt, F.lit(" \n{bad")))
    )
    return table(spark, sf, "pages").select("page_id", shape.alias("payload"))


def read_url_list(spark, sf):
    urls = R.decode_url_lists(_payloads(spark, sf), "payload")
    return Q.dedupe_first(urls, "url", ["page_id", "ord"], out="url").select("page_id", "url")


URL_LIST_SQL = """
WITH s AS (
  SELECT page_id, url, url || '&b' AS alt, CASE WHEN contains(url, 'utm_') THEN 1
    WHEN url LIKE '%.html' THEN 2 WHEN contains(url, '?page=') THEN 3 WHEN url LIKE '%/' THEN 4 ELSE 5 END AS k
  FROM pages),
u AS (
  SELECT page_id, 0 AS o, '1' AS url FROM s WHERE k = 1
  UNION ALL SELECT page_id, 1, url FROM s WHERE k IN (1, 2, 3)
  UNION ALL SELECT page_id, 2, alt FROM s WHERE k IN (2, 4)
  UNION ALL SELECT page_id, 3, url FROM s WHERE k IN (4, 5)
  UNION ALL SELECT page_id, 4, alt FROM s WHERE k = 5
  UNION ALL SELECT page_id, 5, '{bad' FROM s WHERE k = 5)
SELECT page_id, url FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, o) AS rn FROM u) WHERE rn = 1"""


def read_records(spark, sf):
    """Branch records in JSON arrays, one per supplier, with odd elements."""
    key = F.when(F.col("s_nationkey") == 3, F.lit(" ")).otherwise(
        F.concat(F.lit("https://shop.example/"), F.col("s_suppkey").cast("string"))
    )
    body = F.to_json(F.struct(
        F.col("s_name").alias("branch_name"), key.alias("branch_url"),
        F.col("s_nationkey").alias("depth"), (F.col("s_acctbal") < 0).alias("is_up_link"),
    ))
    payload = F.when(F.col("s_nationkey") == 4, body).otherwise(
        F.concat(F.lit('["x", 5, null, '), body, F.lit("]"))
    )
    df = table(spark, sf, "supplier").select("s_suppkey", payload.alias("payload"))
    out = R.decode_records(df, "payload", schemas.BRANCH, "branch_url")
    return out.select(
        "s_suppkey", "ord", "branch_name", "branch_url", F.col("depth").cast("bigint").alias("depth"),
        "is_up_link",
    )


RECORDS_SQL = """
SELECT s_suppkey, 3::BIGINT AS ord, s_name AS branch_name,
  'https://shop.example/' || s_suppkey AS branch_url, s_nationkey::BIGINT AS depth, s_acctbal < 0 AS is_up_link
FROM supplier WHERE s_nationkey NOT IN (3, 4)"""


# ---- streams ---------------------------------------------------------------------
def stream_dedupe(spark, sf):
    stream = _stream(spark, sf, "events").select("user_id", "event_type")
    keys = ["user_id", "event_type"]
    return J.run_to_table(J.stream_dedupe(stream, keys), scratch_path(spark, "dedupe"))


def stream_dedupe_watermark(spark, sf):
    """Keys are kept until the watermark passes them by 400 days, longer than the events last."""
    stream = _stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    found = J.stream_dedupe(stream, ["user_id", "event_type"], "ts", "400 days")
    return J.run_to_table(found.select("user_id", "event_type"), scratch_path(spark, "dedupe-watermark"))


# ---- sinks: written, read again ----------------------------------------------------
def report(spark, sf):
    path = scratch_path(spark, "report")
    reports.write_report(P.page_results(table(spark, sf, "pages"), RP.MARKUP, RP.ITEM_SITE), path)
    return reports.read_report(spark, path)[1]


def upload_log(spark, sf):
    """Orders as log lines, appended in two goes; those of one priority have no key."""
    orders = table(spark, sf, "orders")
    named = F.when(~F.col("o_orderpriority").startswith("1"), F.concat(F.lit("https://shop.example/\"x\"/"), F.col("o_orderkey")))
    first, second, third = (f.name for f in schemas.UPLOAD_LOG.fields[:3])
    rows = orders.select(
        "o_orderkey", named.alias(first), F.col("o_orderpriority").alias(second), F.col("o_orderkey").cast("string").alias(third)
    )
    path = scratch_path(spark, "log")
    for part in (0, 1):
        logs.append_log(rows.where(F.col("o_orderkey") % 2 == part).drop("o_orderkey"), path)
    return logs.read_jsonl_log(spark, path).select(
        F.col(first).alias("key"), F.col(second).alias("value"), F.col(third).cast("bigint").alias("o_orderkey")
    )


LOG_SQL = """
SELECT 'https://shop.example/"x"/' || o_orderkey AS key, o_orderpriority AS value, o_orderkey FROM orders
WHERE NOT starts_with(o_orderpriority, '1')"""


def saved_state(spark, sf):
    """Orders as the tables of a publisher's state, saved and loaded."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("url"), "o_orderkey", "o_orderstatus")
    url = orders.where("o_orderstatus = 'F'").select("url")
    tables = {
        "scalars": orders.agg(F.count(F.lit(1)).alias("n")),
        "queue": orders.where("o_orderstatus = 'O'").select("url", F.col("o_orderkey").alias("pos")),
        "uploaded": url,
        "skipped": orders.where("o_orderstatus = 'P'").select("url"),
        "errors": url.withColumn("error", F.concat(F.lit("late "), "url")),
    }
    path = scratch_path(spark, "state")
    state.save_state(tables, path)
    back = state.load_state(spark, path)
    return (
        back["queue"].select(F.lit("queue").alias("kind"), "url", F.col("pos").cast("string").alias("value"))
        .union(back["uploaded"].select(F.lit("uploaded"), "url", F.lit("")))
        .union(back["skipped"].select(F.lit("skipped"), "url", F.lit("")))
        .union(back["errors"].select(F.lit("errors"), "url", "error"))
        .union(back["scalars"].select(F.lit("scalars"), F.col("n").cast("string"), F.lit("")))
    )


STATE_SQL = """
SELECT CASE o_orderstatus WHEN 'O' THEN 'queue' WHEN 'F' THEN 'uploaded' ELSE 'skipped' END AS kind,
  o_orderkey::VARCHAR AS url, CASE WHEN o_orderstatus = 'O' THEN o_orderkey::VARCHAR ELSE '' END AS value FROM orders
UNION ALL SELECT 'errors', o_orderkey::VARCHAR, 'late ' || o_orderkey FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'scalars', count(*)::VARCHAR, '' FROM orders"""


def stream_merge_log(spark, sf):
    path = scratch_path(spark, "merge")
    earlier = table(spark, sf, "events").filter("event_type = 'signup' AND value > 40").select("user_id").distinct()
    seed = J.seed_state(earlier, f"{path}-seed")
    log = _stream(spark, sf, "events").filter("event_type = 'purchase' AND value > 10")
    merged = J.stream_merge_log(log, path, "user_id", seed)
    old = spark.read.parquet(f"{path}-seed").withColumn("old", F.lit(True))
    return merged.join(old, "user_id", "left").select("user_id", F.col("old").isNull().alias("added"))


MERGE_SQL = """
WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 40),
l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 10)
SELECT user_id, false AS added FROM s
UNION ALL SELECT user_id, true FROM l WHERE user_id NOT IN (SELECT user_id FROM s)"""


def _ticks_of(events):
    gauge = lambda k: F.sqrt(((F.col("event_id") * k) % 10_007).cast("double"))
    return events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
                         gauge(37).alias("cpu"), gauge(53).alias("ram"), gauge(71).alias("gpu"))


def _rounded(out):
    return out.select(
        "user_id", F.col("tick").cast("timestamp_ntz").alias("tick"), "responses", "errors",
        F.round(F.col("rps") * 1000, 6).alias("mrps"), F.round("error_rate", 6).alias("error_rate"),
        F.round("smoothed", 6).alias("smoothed"), "brake", "throughput_drop",
    )


def tick_metrics(spark, sf):
    """Daily ticks per user from the event stream, smoothed and judged inside it."""
    return _rounded(J.stream_tick_metrics(
        _ticks_of(_stream(spark, sf, "events")), scratch_path(spark, "ticks"), "user_id", "ts",
        F.col("event_type") == "error", ["cpu", "ram", "gpu"], 86_400, "2 days", end=True,
    ))


def tick_table_metrics(spark, sf):
    """The same from the stored table, as a batch job."""
    ticks = J.tick_counts(
        _ticks_of(table(spark, sf, "events")), "user_id", "ts", F.col("event_type") == "error", ["cpu", "ram", "gpu"], "1 day"
    )
    return _rounded(J.tick_metrics(ticks, "user_id", 86_400))


TICK_SQL = """
WITH t AS (
  SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS tick, count(*) FILTER (event_type <> 'error')::BIGINT AS responses,
    count(*) FILTER (event_type = 'error')::BIGINT AS errors,
    avg(sqrt(((event_id * 37) % 10007)::DOUBLE)) AS cpu, avg(sqrt(((event_id * 53) % 10007)::DOUBLE)) AS ram,
    avg(sqrt(((event_id * 71) % 10007)::DOUBLE)) AS gpu FROM events GROUP BY 1, 2),
r AS (
  SELECT *, responses / 86400::DOUBLE AS rps, errors::DOUBLE / greatest(1, responses + errors) AS er,
    cpu / 100 * 0.5::DOUBLE + ram / 100 * 0.35::DOUBLE + gpu / 100 * 0.15::DOUBLE AS x FROM t),
s AS (
  SELECT *, list_reduce(list_prepend(0::DOUBLE, list(x) OVER w), lambda a, b: a * 0.65::DOUBLE + b * 0.35::DOUBLE)
      AS smoothed, lag(rps) OVER (PARTITION BY user_id ORDER BY tick) AS prev
  FROM r WINDOW w AS (PARTITION BY user_id ORDER BY tick ROWS UNBOUNDED PRECEDING))
SELECT user_id, tick, responses, errors, round(rps * 1000, 6) AS mrps, round(er, 6) AS error_rate,
  round(smoothed, 6) AS smoothed,
  (CASE WHEN cpu >= 97 OR ram >= 96 THEN 0.55 WHEN cpu >= 93 OR ram >= 92 THEN 0.75 WHEN er >= 0.08 THEN 0.6
    WHEN er >= 0.04 THEN 0.8 ELSE 1 END)::DOUBLE AS brake,
  coalesce(prev > 0 AND rps < prev * 0.75 AND smoothed > 0.6, false) AS throughput_drop FROM s"""


def stream_queue_cursor(spark, sf):
    return J.stream_queue_cursor(
        _stream(spark, sf, "events"), scratch_path(spark, "cursor"), "user_id", ["ts", "event_id"],
        F.col("event_type").isin("view", "click", "purchase"),
        F.col("event_type").isin("error", "signup"),
    )


CURSOR_SQL = """
WITH s AS (
  SELECT user_id, ts, event_id, CASE WHEN event_type IN ('error', 'signup') THEN -1 ELSE 1 END AS step FROM events),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT user_id, count(*) FILTER (step = 1)::BIGINT AS taken, count(*) FILTER (step = -1)::BIGINT AS failures,
  (sum(step) - least(0, min(run)))::BIGINT AS cursor FROM r GROUP BY user_id"""


def stream_pages(spark, sf):
    out = J.stream_page_results(
        _stream(spark, sf, "pages"), scratch_path(spark, "pages"), RP.MARKUP, RP.ITEM_SITE
    )
    return out.select(
        "page_id", "url", "title", "description", "has_video", "video_count",
        F.array_join("signals", ",").alias("signals"), "blocked", "error",
    )


def page_progress(spark, sf):
    """Counts per batch while pages arrive, a quarter of the table, in as many files as it has tasks, in each batch."""
    path = scratch_path(spark, "arriving")
    pages = table(spark, sf, "pages")
    results = None
    for part in range(4):
        pages.filter(F.pmod("page_id", F.lit(4)) == part).write.mode("append").parquet(path)
        if results is None:
            results = J.observed_results(spark.readStream.schema(pages.schema).parquet(path), RP.MARKUP, RP.ITEM_SITE)
        # All files that are new are one batch; the query goes on from its checkpoint.
        J.run_stream(results, f"{path}-results", progress=f"{path}-counts")
    return J.read_progress(spark, f"{path}-counts").select("pages", "with_video", "without_video", "blocked", "errors")


PROGRESS_SQL = f"""
SELECT count(*)::BIGINT AS pages, count(*) FILTER (has_video)::BIGINT AS with_video,
  count(*) FILTER (NOT has_video)::BIGINT AS without_video, count(*) FILTER (blocked)::BIGINT AS blocked,
  count(*) FILTER (coalesce(error, '') <> '')::BIGINT AS errors
FROM ({RP.SQL["page_results"]}) GROUP BY page_id % 4"""


def stream_kept_counts(spark, sf):
    """Rows read, kept and removed while URLs are deduplicated, over all batches."""
    urls = _stream(spark, sf, "pages").select("url").where("url is not null")
    counts = J.stream_kept_counts(urls, ["url"], scratch_path(spark, "kept"))
    return counts.agg(*[F.sum(c).alias(c) for c in ("original", "kept", "removed")])


KEPT_SQL = """
SELECT count(*)::BIGINT AS original, count(DISTINCT url)::BIGINT AS kept, (count(*) - count(DISTINCT url))::BIGINT AS removed
FROM pages WHERE url IS NOT NULL"""


QUERIES = {
    f.__name__: f
    for f in (
        read_url_list, read_records, report, upload_log, saved_state, stream_dedupe,
        stream_dedupe_watermark, stream_merge_log, tick_metrics, tick_table_metrics, stream_queue_cursor, stream_pages, page_progress, stream_kept_counts,
    )
}
SQL = {
    "read_url_list": URL_LIST_SQL,
    "read_records": RECORDS_SQL,
    "report": RP.REPORT_SQL,
    "upload_log": LOG_SQL,
    "saved_state": STATE_SQL,
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_dedupe_watermark": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_merge_log": MERGE_SQL,
    "tick_metrics": TICK_SQL,
    "tick_table_metrics": TICK_SQL,
    "stream_queue_cursor": CURSOR_SQL,
    "stream_pages": RP.SQL["page_results"],
    "page_progress": PROGRESS_SQL,
    "stream_kept_counts": KEPT_SQL,
}
