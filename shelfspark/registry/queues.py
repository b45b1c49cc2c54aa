"""Queue queries: dedupe, pending, recovery, log merge, slots, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.urls import canonical_section
from shelfspark.operators import aggregates as A
from shelfspark.operators import queues as Q
from shelfspark.operators.text import phrase_flags as flag_phrases
from shelfspark.registry.base import canonical, collapse, lit, table

# ---- dedupe and order ---------------------------------------------------------


def dedupe_first(spark, sf):
    """First page per host and path, and first document per text."""
    pages = Q.dedupe_first(
        table(spark, sf, "pages").select("page_id", "url"),
        F.regexp_extract(canonical_section("url"), "^https://([^/]*)", 1), ["page_id"], "key",
    ).select(F.lit("host").alias("kind"), F.col("page_id").alias("id"), "key")
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    docs = Q.dedupe_first(docs, "h", ["doc_id"], "key").select(
        F.lit("text").alias("kind"), F.col("doc_id").alias("id"), "key"
    )
    return pages.unionByName(docs)


DEDUPE_SQL = f"""
SELECT 'host' AS kind, min(page_id) AS id, regexp_extract({canonical('url')}, '^https://([^/]*)', 1) AS key
FROM pages GROUP BY 3
UNION ALL SELECT 'text', min(doc_id), sha256(text) FROM documents GROUP BY text"""


def kept_counts(spark, sf):
    return Q.kept_counts(table(spark, sf, "pages"), canonical_section("url"))


KEPT_SQL = f"""
SELECT count(*)::BIGINT AS original, count(DISTINCT {canonical('url')})::BIGINT AS kept,
  (count(*) - count(DISTINCT {canonical('url')}))::BIGINT AS removed FROM pages"""


def union_sources(spark, sf):
    """Labelled documents, then all documents, then benchmark items, by text."""
    docs = table(spark, sf, "documents")
    text = lambda d, i: d.select(F.sha2("text", 256).alias("h"), F.col(i).alias("id"))
    good = docs.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id").distinct(),
                     "doc_id", "left_semi")
    out = Q.union_sources(
        [text(good, "doc_id"), text(docs, "doc_id"), text(table(spark, sf, "benchmark"), "item_id")],
        "h", ["id"],
    )
    return out.select("h", "id", F.col("source_no").cast("bigint").alias("source_no"))


UNION_SQL = """
WITH u AS (
  SELECT sha256(text) AS h, doc_id AS id, 0::BIGINT AS source_no FROM documents d
  WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
  UNION ALL SELECT sha256(text), doc_id, 1 FROM documents
  UNION ALL SELECT sha256(text), item_id, 2 FROM benchmark)
SELECT h, id, source_no FROM (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY source_no, id) AS rn FROM u) WHERE rn = 1"""


def restore_order(spark, sf):
    """Pages get their position in a link list that repeats some and lacks others."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    order = pages.filter(F.col("url").startswith("https")).select("url", F.col("page_id").alias("ord"))
    order = order.unionByName(
        pages.filter(F.col("url").contains("?page=")).select(
            "url", (F.col("page_id") + 100_000_000).alias("ord")
        )
    )
    return Q.restore_order(pages, order).select("page_id", "url", "ord")


RESTORE_SQL = """
WITH o AS (
  SELECT url, page_id AS ord FROM pages WHERE starts_with(url, 'https')
  UNION ALL SELECT url, page_id + 100000000 FROM pages WHERE contains(url, '?page=')),
m AS (SELECT url, max(ord) AS ord FROM o GROUP BY url)
SELECT p.page_id, p.url, m.ord::BIGINT AS ord
FROM pages p LEFT JOIN m ON p.url = m.url"""


def limit_first(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return Q.limit_first(df, 50, ["lang", F.desc("n_chars"), "doc_id"])


LIMIT_SQL = "SELECT doc_id, lang, n_chars FROM documents ORDER BY lang, n_chars DESC, doc_id LIMIT 50"


def first_valid(spark, sf):
    df = table(spark, sf, "pages").select("page_id", "url")
    return Q.first_valid(df, F.col("url").rlike(r"/fr/.*\?page"), ["page_id"])


FIRST_VALID_SQL = r"""
SELECT page_id, url FROM pages WHERE regexp_matches(url, '/fr/.*\?page') ORDER BY page_id LIMIT 1"""

_MEDIA_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def top_n_per_key(spark, sf):
    """First three media (line items) per item (order), with numbered names."""
    df = table(spark, sf, "lineitem").select("l_orderkey", *_MEDIA_ORDER)
    out = Q.top_n_per_key(df, ["l_orderkey"], _MEDIA_ORDER, 3, "n")
    return out.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.format_string("%d_video_%02d.mp4", "l_orderkey", "n").alias("media_name"),
    )


TOP_N_SQL = """
SELECT l_orderkey, l_partkey, l_linenumber,
  l_orderkey || '_video_' || lpad(n::VARCHAR, 2, '0') || '.mp4' AS media_name
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
WHERE n <= 3"""


def latest_per_key(spark, sf):
    """Newest event per user; purchases count as artifacts seen before."""
    df = table(spark, sf, "events").withColumn("path", F.lpad(F.col("event_id").cast("string"), 12, "0"))
    out = Q.latest_per_key(df, "user_id", "ts", "path", seen=F.col("event_type") == "purchase")
    return out.select("user_id", "event_id", "event_type", "ts")


LATEST_SQL = """
SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY (event_type <> 'purchase') DESC, ts DESC, event_id) AS rn FROM events) WHERE rn = 1"""

PHRASES = ("the this", "und der", "avec", "token =", "[removed]")


def phrase_flags(spark, sf):
    out = flag_phrases(table(spark, sf, "documents"), "text", PHRASES, "flagged")
    return out.select("doc_id", "flagged")


PHRASE_SQL = "SELECT doc_id, ({}) AS flagged FROM documents".format(
    " OR ".join(f"contains(lower(text), {lit(p)})" for p in PHRASES)
)


# ---- joins ------------------------------------------------------------------------
SECTIONS = {"small": "tiny-things", "promo": "promo", "economy": "value", "red widget": "red",
            "hot gear": "gears"}


def lookup_slug(spark, sf):
    """Part types and names resolved against a small section dimension."""
    part = table(spark, sf, "part")
    names = part.select("p_partkey", F.concat(F.lit("  "), F.col("p_type"), F.lit(" ")).alias("name"))
    names = names.unionByName(part.select("p_partkey", F.initcap("p_name").alias("name")))
    names = names.unionByName(
        part.select("p_partkey", F.concat_ws(" &  ", "p_brand", "p_type").alias("name"))
    )
    return Q.lookup_slug(names, "name", SECTIONS).select("p_partkey", "name", "slug", "known", "start_url")


_DIM = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in SECTIONS.items())
LOOKUP_SLUG_SQL = rf"""
WITH n AS (
  SELECT p_partkey, '  ' || p_type || ' ' AS name FROM part
  UNION ALL SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:]
    || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] FROM part
  UNION ALL SELECT p_partkey, p_brand || ' &  ' || p_type FROM part),
w AS (SELECT *, lower({collapse('name')}) AS wanted FROM n),
g AS (
  SELECT *, trim(regexp_replace(replace(wanted, '&', 'and'), '[^a-z0-9]+', '-', 'g'), '-') AS guess FROM w),
s AS (
  SELECT g.*, d.slug IS NOT NULL AS known, CASE WHEN d.slug IS NOT NULL THEN d.slug
    WHEN regexp_matches(wanted, '^[a-z0-9-]+$') THEN wanted WHEN guess <> '' THEN guess
    ELSE 'kitchen' END AS slug
  FROM g LEFT JOIN (VALUES {_DIM}) d(name, slug) ON g.wanted = d.name)
SELECT p_partkey, name, slug, known,
  'https://shop.example/gp/bestsellers/' || slug || '/ref=zg_bs_nav_' || slug || '_0' AS start_url
FROM s"""


def pending_queue(spark, sf):
    """Orders without a returned line (done) or an open one (skipped)."""
    lines = table(spark, sf, "lineitem")
    key = F.col("l_orderkey").alias("o_orderkey")
    done = lines.filter("l_returnflag = 'R'").select(key)
    skipped = lines.filter("l_linestatus = 'O' AND l_quantity > 45").select(key)
    items = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return Q.pending(items, done, skipped, "o_orderkey", ["o_custkey"], ["o_orderkey"])


PENDING_SQL = """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'
  UNION SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45)"""


def _recover(spark, sf):
    docs = table(spark, sf, "documents")
    skipped = docs.filter("lang <> 'en'").select(
        F.col("doc_id").alias("url"),
        F.when(F.col("source") != "src3", F.col("doc_id").cast("string")).otherwise("").alias("item_key"),
    )
    ready = table(spark, sf, "labels").filter("toxic = 0").select(
        F.col("doc_id").cast("string").alias("item_key")
    )
    queue = docs.select(F.col("doc_id").alias("url"), (F.col("doc_id") * 3).alias("pos"))
    cursor = docs.select((F.max("doc_id") * 2).alias("cursor"))
    return Q.recover_skipped(skipped, ready, queue, cursor)


def recover_skipped(spark, sf):
    recovered, remaining, cursor = _recover(spark, sf)
    kinds = lambda df, c, k: df.select(F.lit(k).alias("kind"), F.col(c).alias("id"))
    return (
        kinds(recovered, "url", "recovered")
        .unionByName(kinds(remaining, "url", "skipped"))
        .unionByName(kinds(cursor, "cursor", "cursor"))
    )


RECOVER_SQL = """
WITH s AS (SELECT doc_id, source <> 'src3' AS keyed FROM documents WHERE lang <> 'en'),
r AS (SELECT doc_id FROM s WHERE keyed AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))
SELECT 'recovered' AS kind, doc_id AS id FROM r
UNION ALL SELECT 'skipped', doc_id FROM s WHERE doc_id NOT IN (SELECT doc_id FROM r)
UNION ALL SELECT 'cursor', least((SELECT max(doc_id) * 2 FROM documents), (SELECT min(doc_id) * 3 FROM r))"""


def merge_log(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("url"), "event_type", "value")
    state = events.filter("event_type = 'signup' AND value > 20").select("url")
    log = events.filter("event_type = 'purchase' AND value > 10").select("url")
    return Q.merge_log(state, log).select(F.col("url").alias("user_id"), "added")


MERGE_SQL = """
WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 20),
l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 10)
SELECT user_id, false AS added FROM s
UNION ALL SELECT user_id, true FROM l WHERE user_id NOT IN (SELECT user_id FROM s)"""


def lookup_fallback(spark, sf):
    keys = table(spark, sf, "documents").select("doc_id")
    rows = table(spark, sf, "labels").withColumn("ord", F.col("doc_id"))
    first = Q.lookup_with_fallback(keys, rows, "doc_id", ["ord"], ["quality", "toxic"], "first")
    null = Q.lookup_with_fallback(keys, rows, "doc_id", ["ord"], ["quality", "toxic"], "null")
    both = first.withColumn("mode", F.lit("first")).unionByName(null.withColumn("mode", F.lit("null")))
    return both.select("doc_id", "mode", "matched", F.col("quality").cast("bigint").alias("quality"),
                       F.col("toxic").cast("bigint").alias("toxic"))


LOOKUP_FALLBACK_SQL = """
WITH f AS (SELECT quality, toxic FROM labels ORDER BY doc_id LIMIT 1),
j AS (
  SELECT d.doc_id, l.doc_id IS NOT NULL AS matched, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, 'null' AS mode, matched, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM j
UNION ALL SELECT doc_id, 'first', matched,
  (CASE WHEN matched THEN j.quality ELSE (SELECT quality FROM f) END)::BIGINT,
  (CASE WHEN matched THEN j.toxic ELSE (SELECT toxic FROM f) END)::BIGINT FROM j"""


# ---- slots --------------------------------------------------------------------------
def next_slot(spark, sf):
    return Q.next_slot(table(spark, sf, "events"), "ts").select("event_id", "next_slot")


_SLOTS_CTE = """
WITH cal AS (
  SELECT (d + m * INTERVAL 1 MINUTE)::TIMESTAMP AS slot FROM (
    SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events)::TIMESTAMP,
      (SELECT max(ts)::DATE + 1 FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS d),
    (SELECT unnest([690, 1050, 1170]) AS m)),
e AS (SELECT event_id, ts, slot AS next_slot FROM events ASOF LEFT JOIN cal ON ts < slot)
"""
NEXT_SLOT_SQL = _SLOTS_CTE + "SELECT event_id, next_slot FROM e"


def deadlines(spark, sf):
    df = Q.next_slot(table(spark, sf, "events"), "ts")
    out = Q.deadlines(df, "ts", wake_minutes=90, cutoff_minutes=20)
    return out.select("event_id", "wake_at", "cutoff_at", "phase")


DEADLINES_SQL = _SLOTS_CTE + """
SELECT event_id, next_slot - INTERVAL 90 MINUTE AS wake_at, next_slot - INTERVAL 20 MINUTE AS cutoff_at,
  CASE WHEN ts < next_slot - INTERVAL 90 MINUTE THEN 'sleep'
       WHEN ts < next_slot - INTERVAL 20 MINUTE THEN 'prepare'
       WHEN ts < next_slot THEN 'wait' ELSE 'missed' END AS phase FROM e"""


def _schedules(spark, sf):
    """One schedule text per nation: some repeat slots, some are broken."""
    k = F.col("n_nationkey")
    text = F.concat_ws(
        ",",
        F.format_string("%02d:%02d", k, (k * 7) % 60),
        F.when(k % 3 == 0, F.lit(" 19:30 ")),
        F.when(k % 3 == 1, F.format_string("%02d:%02d", k, (k * 7) % 60)),
        F.when(k % 4 == 3, F.lit("")),
        F.when(k == 5, F.lit("7:5")),
        F.when(k == 6, F.lit("noon")),
    )
    return table(spark, sf, "nation").select("n_nationkey", text.alias("slots"))


def slot_calendar(spark, sf):
    calendar, rejects = Q.slot_calendar(_schedules(spark, sf), "slots", "2024-01-01", "2024-01-05")
    good = calendar.select("n_nationkey", "slot_at", F.lit(False).alias("rejected"))
    return good.unionByName(
        rejects.select("n_nationkey", F.lit(None).cast("timestamp_ntz").alias("slot_at"),
                       F.lit(True).alias("rejected"))
    )


CALENDAR_SQL = r"""
WITH s AS (
  SELECT n_nationkey AS k, concat_ws(',', printf('%02d:%02d', n_nationkey, (n_nationkey * 7) % 60),
    CASE WHEN n_nationkey % 3 = 0 THEN ' 19:30 ' END,
    CASE WHEN n_nationkey % 3 = 1 THEN printf('%02d:%02d', n_nationkey, (n_nationkey * 7) % 60) END,
    CASE WHEN n_nationkey % 4 = 3 THEN '' END, CASE WHEN n_nationkey = 5 THEN '7:5' END,
    CASE WHEN n_nationkey = 6 THEN 'noon' END) AS t FROM nation),
x AS (SELECT k, trim(unnest(string_split(t, ','))) AS tok FROM s),
v AS (
  SELECT k, try_cast(nullif(regexp_extract(tok, '^\s*([0-9]+)\s*:\s*([0-9]+)\s*$', 1), '') AS INT) AS h,
    try_cast(nullif(regexp_extract(tok, '^\s*([0-9]+)\s*:\s*([0-9]+)\s*$', 2), '') AS INT) AS m
  FROM x WHERE tok <> ''),
ok AS (
  SELECT DISTINCT k, h * 60 + m AS minute FROM v
  WHERE k NOT IN (SELECT k FROM v WHERE h IS NULL OR m IS NULL OR h > 23 OR m > 59))
SELECT k AS n_nationkey, (d + minute * INTERVAL 1 MINUTE)::TIMESTAMP AS slot_at, false AS rejected
FROM ok, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-05', INTERVAL 1 DAY)) AS d)
UNION ALL SELECT n_nationkey, NULL, true FROM nation WHERE n_nationkey NOT IN (SELECT k FROM ok)"""


def _calendar(spark, sf):
    return Q.slot_calendar(_schedules(spark, sf), "slots", "2024-01-01", "2024-03-31")[0].select("n_nationkey", "slot_at")


def assign_calendar_slots(spark, sf):
    """Suppliers of a nation in key order onto the nation's own calendar."""
    queue = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    out = Q.assign_calendar_slots(queue, "s_suppkey", _calendar(spark, sf), "2024-01-03 10:00:00", ["n_nationkey"])
    return out.select("n_nationkey", "s_suppkey", "slot_no", "slot_at")


def next_calendar_slot(spark, sf):
    """Next slot of a nation after the order time of day of each of its customers' orders."""
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey"
    )
    moment = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") * 37 % 135_000).cast("int"))
    asked = orders.select("o_orderkey", "n_nationkey", moment.alias("asked_at"))
    return Q.next_calendar_slot(asked, "asked_at", _calendar(spark, sf), "n_nationkey")


_CALENDAR = CALENDAR_SQL.split("\nSELECT k AS n_nationkey")[0] + """,
cal AS (
  SELECT k AS n_nationkey, (d + minute * INTERVAL 1 MINUTE)::TIMESTAMP AS slot_at
  FROM ok, (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) AS d))"""
ASSIGN_CALENDAR_SQL = _CALENDAR + """,
c AS (
  SELECT n_nationkey, slot_at, row_number() OVER (PARTITION BY n_nationkey ORDER BY slot_at) AS slot_no
  FROM cal WHERE slot_at > TIMESTAMP '2024-01-03 10:00:00'),
q AS (
  SELECT s_nationkey AS n_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS slot_no
  FROM supplier)
SELECT q.n_nationkey, s_suppkey, q.slot_no, slot_at FROM q LEFT JOIN c ON q.n_nationkey = c.n_nationkey AND q.slot_no = c.slot_no"""
NEXT_CALENDAR_SQL = _CALENDAR + """,
a AS (
  SELECT o_orderkey, c_nationkey AS n_nationkey,
    (TIMESTAMP '2024-01-01' + (o_orderkey * 37 % 135000) * INTERVAL 1 MINUTE)::TIMESTAMP AS asked_at
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT a.o_orderkey, a.n_nationkey, a.asked_at, min(slot_at) AS next_slot
FROM a LEFT JOIN cal ON cal.n_nationkey = a.n_nationkey AND slot_at > asked_at GROUP BY 1, 2, 3"""


def assign_slots(spark, sf):
    """Open orders in key order onto the daily slots after a start time."""
    queue = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    out = Q.assign_slots(queue, "o_orderkey", "2024-01-01 18:00:00", chunk_width=4096)
    return out.select("o_orderkey", "slot_no", "slot_at")


ASSIGN_SQL = """
WITH q AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS slot_no FROM orders
  WHERE o_orderstatus = 'O'),
c AS (
  SELECT slot_at, row_number() OVER (ORDER BY slot_at) AS n FROM (
    SELECT (TIMESTAMP '2024-01-01' + d * INTERVAL 1 DAY + m * INTERVAL 1 MINUTE)::TIMESTAMP AS slot_at
    FROM (SELECT unnest(range((SELECT count(*) // 3 + 3 FROM q))) AS d), (SELECT unnest([690, 1050, 1170]) AS m))
  WHERE slot_at > TIMESTAMP '2024-01-01 18:00:00')
SELECT o_orderkey, slot_no, slot_at FROM q JOIN c ON q.slot_no = c.n"""


# ---- status ---------------------------------------------------------------------------
def error_by_key(spark, sf):
    e = table(spark, sf, "events")
    return Q.error_by_key(
        e.withColumn("msg", F.concat_ws(" ", "event_type", "props")), "user_id", ["ts", "event_id"],
        F.col("event_type") == "error", F.col("event_type") == "purchase", "msg",
    )


ERROR_SQL = """
SELECT user_id, event_type || ' ' || props AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE event_type IN ('error', 'purchase')) WHERE rn = 1 AND event_type = 'error'"""


def branch_progress(spark, sf):
    """Orders per customer; returned lines close an order, big open lines skip it."""
    lines = table(spark, sf, "lineitem")
    closed = lines.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("l_returnflag") == "R", "done")
        .when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45), "skipped").alias("state"),
    ).filter("state IS NOT NULL")
    items = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return Q.branch_progress(items, closed, "o_custkey", "o_orderkey", "o_orderkey")


_PROGRESS_CTE = """
WITH c AS (
  SELECT l_orderkey AS k, min(CASE WHEN l_returnflag = 'R' THEN 'done' ELSE 'skipped' END) AS state
  FROM lineitem WHERE l_returnflag = 'R' OR (l_linestatus = 'O' AND l_quantity > 45) GROUP BY 1),
p AS (
  SELECT o_custkey, count(*)::BIGINT AS total, count(*) FILTER (state = 'done')::BIGINT AS done,
    count(*) FILTER (state = 'skipped')::BIGINT AS skipped,
    count(*) FILTER (state IS NULL)::BIGINT AS pending,
    min(o_orderkey) FILTER (state IS NULL) AS next_item
  FROM orders LEFT JOIN c ON o_orderkey = k GROUP BY o_custkey)
"""
PROGRESS_SQL = _PROGRESS_CTE + "SELECT *, pending = 0 AS finished FROM p"


def next_branch(spark, sf):
    return Q.next_branch(branch_progress(spark, sf), "o_custkey")


def gauge_stats(spark, sf):
    """Gauge lines written from events; low values come as broken lines."""
    e = table(spark, sf, "events")
    line = F.when(F.col("value") < 3, F.concat(F.lit("n/a, "), F.col("value").cast("string"))) \
        .otherwise(F.concat_ws(", ", (F.col("event_id") % 101).cast("string"), F.lit("8192"),
                               ((F.col("event_id") * 7) % 8000).cast("string")))
    out = A.gauge_stats(e, line, ("event_type",))
    return out.select("event_type", "gauges", *[
        F.round(c, 6).alias(c) for c in ("util_avg", "util_peak", "mem_percent", "total_gb", "used_gb")
    ])


GAUGE_SQL = """
SELECT event_type, count(*)::BIGINT AS gauges, round(avg(event_id % 101), 6) AS util_avg,
  round(max(event_id % 101)::DOUBLE, 6) AS util_peak,
  round(sum((event_id * 7) % 8000)::DOUBLE / (count(*) * 8192) * 100, 6) AS mem_percent,
  round(count(*) * 8192 / 1024.0::DOUBLE, 6) AS total_gb,
  round(sum((event_id * 7) % 8000)::DOUBLE / 1024, 6) AS used_gb
FROM events WHERE value >= 3 GROUP BY event_type"""


def queue_cursor(spark, sf):
    """Views take an item, errors fail its publish."""
    return Q.queue_cursor(
        table(spark, sf, "events"), "user_id", ["ts", "event_id"], None,
        F.col("event_type").isin("view", "click"), F.col("event_type").isin("error", "signup", "purchase"),
    )


CURSOR_SQL = """
WITH s AS (
  SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE -1 END AS step
  FROM events),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
SELECT user_id, count(*) FILTER (step = 1)::BIGINT AS taken, count(*) FILTER (step = -1)::BIGINT AS failures,
  (sum(step) - least(0, min(run)))::BIGINT AS cursor FROM r GROUP BY user_id"""

QUERIES = {
    f.__name__: f
    for f in (
        dedupe_first, kept_counts, union_sources, restore_order, limit_first, first_valid,
        top_n_per_key, latest_per_key, phrase_flags, lookup_slug, pending_queue, recover_skipped,
        merge_log, lookup_fallback, next_slot, deadlines, slot_calendar, assign_slots, assign_calendar_slots,
        next_calendar_slot, error_by_key,
        branch_progress, next_branch, gauge_stats, queue_cursor,
    )
}
SQL = {
    "dedupe_first": DEDUPE_SQL, "kept_counts": KEPT_SQL, "union_sources": UNION_SQL,
    "restore_order": RESTORE_SQL, "limit_first": LIMIT_SQL, "first_valid": FIRST_VALID_SQL,
    "top_n_per_key": TOP_N_SQL, "latest_per_key": LATEST_SQL, "phrase_flags": PHRASE_SQL,
    "lookup_slug": LOOKUP_SLUG_SQL, "pending_queue": PENDING_SQL, "recover_skipped": RECOVER_SQL,
    "merge_log": MERGE_SQL, "lookup_fallback": LOOKUP_FALLBACK_SQL, "next_slot": NEXT_SLOT_SQL,
    "deadlines": DEADLINES_SQL, "slot_calendar": CALENDAR_SQL, "assign_slots": ASSIGN_SQL,
    "assign_calendar_slots": ASSIGN_CALENDAR_SQL, "next_calendar_slot": NEXT_CALENDAR_SQL,
    "error_by_key": ERROR_SQL, "branch_progress": PROGRESS_SQL,
    "next_branch": _PROGRESS_CTE + "SELECT min(o_custkey) AS next_branch FROM p WHERE pending > 0",
    "gauge_stats": GAUGE_SQL, "queue_cursor": CURSOR_SQL,
}
