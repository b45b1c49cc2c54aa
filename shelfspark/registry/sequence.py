"""Ordered queries: interleaving, rates, smoothing, segment timing, reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.core import epoch_micros, extract_all
from shelfspark.functions.urls import canonical_section
from shelfspark.operators import graph as G
from shelfspark.operators import sequence as S
from shelfspark.profiles import FALLBACK_CLOSE, FALLBACK_LINE
from shelfspark.registry.base import canonical, table


def interleave(spark, sf):
    df = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(canonical_section("url"), "^https://([^/]*)", 1).alias("host")
    )
    return S.interleave(df, "host", "page_id", 4_096)


INTERLEAVE_SQL = f"""
SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS round_no,
  min(page_id) OVER (PARTITION BY host) AS cluster_first
FROM (SELECT page_id, regexp_extract({canonical('url')}, '^https://([^/]*)', 1) AS host FROM pages)"""


# ---- ticks: events stand for counter samples of a source (user) -----------------
def _ticks(spark, sf):
    e = table(spark, sf, "events")
    gauge = lambda k: F.sqrt(((F.col("event_id") * k) % 10_007).cast("double"))
    return e.select(
        "event_id", "user_id", "ts",
        F.floor(F.col("value") * 40).cast("bigint").alias("responses"),
        F.floor(F.col("value")).cast("bigint").alias("errors"),
        gauge(37).alias("cpu"), gauge(53).alias("ram"), gauge(71).alias("gpu"),
    )


ORDER = ["ts", "event_id"]
_TICKS = """
t AS (
  SELECT event_id, user_id, ts, floor(value * 40)::BIGINT AS responses, floor(value)::BIGINT AS errors,
    sqrt(((event_id * 37) % 10007)::DOUBLE) AS cpu, sqrt(((event_id * 53) % 10007)::DOUBLE) AS ram,
    sqrt(((event_id * 71) % 10007)::DOUBLE) AS gpu FROM events),
l AS (
  SELECT *, lag(responses) OVER w AS pr, lag(errors) OVER w AS pe, lag(ts) OVER w AS pt FROM t
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (
  SELECT *, greatest(0, responses - pr) AS dr, greatest(0, errors - pe) AS de,
    (epoch_us(ts) - epoch_us(pt)) / 1e6 AS dt FROM l),
r AS (
  SELECT *, CASE WHEN pt IS NOT NULL THEN dr / greatest(0.2::DOUBLE, dt) END AS rps,
    CASE WHEN pt IS NOT NULL THEN de::DOUBLE / greatest(1, dr + de) END AS error_rate,
    cpu / 100 * 0.5::DOUBLE + ram / 100 * 0.35::DOUBLE + gpu / 100 * 0.15::DOUBLE AS x FROM d),
s AS (
  SELECT *, list_reduce(list_prepend(0::DOUBLE, list(x) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING)), lambda a, b: a * 0.65::DOUBLE + b * 0.35::DOUBLE) AS smoothed FROM r)
"""


def counter_rates(spark, sf):
    out = S.counter_rates(_ticks(spark, sf), "user_id", ORDER)
    return out.select("event_id", F.round("rps", 6).alias("rps"), F.round("error_rate", 6).alias("error_rate"))


def ewma(spark, sf):
    df = _ticks(spark, sf).withColumn("x", S.pressure(F.col("cpu"), F.col("ram"), F.col("gpu")))
    out = S.ewma(df, "user_id", ORDER, "x")
    return out.select("event_id", F.round("smoothed", 6).alias("smoothed"))


def load_class(spark, sf):
    out = S.load_metrics(_ticks(spark, sf), "user_id", ORDER)
    return out.select("event_id", "brake", "throughput_drop")


LOAD_SQL = "WITH " + _TICKS + """
SELECT event_id, (CASE WHEN cpu >= 97 OR ram >= 96 THEN 0.55 WHEN cpu >= 93 OR ram >= 92 THEN 0.75
    WHEN error_rate >= 0.08 THEN 0.6 WHEN error_rate >= 0.04 THEN 0.8 ELSE 1 END)::DOUBLE AS brake,
  coalesce(prev > 0 AND rps < prev * 0.75 AND smoothed > 0.6, false) AS throughput_drop
FROM (SELECT *, lag(rps) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM s)"""


# ---- scripts: conversations stand for scripts of ordered lines -------------------
TOTAL = 24.0


def _lines(spark, sf):
    """One script in seven has blank lines only, one in five a blank first line."""
    blank = (F.col("conv_id") % 7 == 3) | ((F.col("conv_id") % 5 == 1) & (F.col("turn") == 0))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.when(blank, F.lit(" ")).otherwise(F.trim("text")).alias("text")
    )


_SCRIPTS = """
conv AS (
  SELECT conv_id, turn, role,
    CASE WHEN conv_id % 7 = 3 OR (conv_id % 5 = 1 AND turn = 0) THEN '' ELSE trim(text) END AS text FROM conversations),
stock AS (
  SELECT conv_id FROM conv GROUP BY conv_id HAVING max(text) = '')"""


def _stock(focus: str = "") -> str:
    return f"""
UNION ALL SELECT conv_id, 1, 0.0, {TOTAL / 2}, {TOTAL / 2}, {focus}'{FALLBACK_LINE}' FROM stock
UNION ALL SELECT conv_id, 2, {TOTAL / 2}, {TOTAL}, {TOTAL / 2}, {focus}'{FALLBACK_CLOSE}' FROM stock"""


def split_even(spark, sf):
    out = S.join_pieces(S.split_even(_lines(spark, sf), "conv_id", "turn", "text", F.lit(TOTAL), 3, piece_size=120), "conv_id")
    return out


SPLIT_EVEN_SQL = f"""
WITH {_SCRIPTS},
n AS (
  SELECT conv_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM conv WHERE text <> ''),
g AS (SELECT *, CASE WHEN n > 3 THEN (n + 2) // 3 ELSE 1 END AS size FROM n),
s AS (
  SELECT conv_id, (i - 1) // size + 1 AS k, trim(string_agg(t, ' ' ORDER BY i)) AS line,
    max((n + size - 1) // size) AS segs FROM g GROUP BY 1, 2),
a AS (
  SELECT conv_id, k, line, CASE WHEN segs < 2 THEN 2 ELSE segs END AS segs FROM s
  UNION ALL SELECT conv_id, 2, '{FALLBACK_CLOSE}', 2 FROM s WHERE segs < 2)
SELECT conv_id, k::BIGINT AS scene_index, round({TOTAL}::DOUBLE / segs * (k - 1), 3) AS start_sec,
  round(CASE WHEN k = segs THEN {TOTAL}::DOUBLE ELSE {TOTAL}::DOUBLE / segs * k END, 3) AS end_sec,
  round(CASE WHEN k = segs THEN {TOTAL}::DOUBLE ELSE {TOTAL}::DOUBLE / segs * k END
    - {TOTAL}::DOUBLE / segs * (k - 1), 3) AS duration_sec, line FROM a{_stock()}"""


def _allocated(spark, sf):
    rows = _lines(spark, sf).select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("user_line"),
        F.col("text").alias("line_text"),
        # Assistant lines of even scripts come with model times, some unusable.
        F.when((F.col("conv_id") % 2 == 0) & (F.col("role") != "user"),
               (F.col("turn") * 7 % 20).cast("string")).otherwise("n/a").alias("begin"),
        F.when(F.col("turn") % 3 > 0, (F.col("turn") * 7 % 20 + 5).cast("string")).alias("finish"),
    )
    return S.allocate_weighted(
        rows, "conv_id", "turn", ["user_line", "line_text"], F.lit(TOTAL), 1.2,
        F.col("begin"), F.col("finish"),
    )


def allocate_weighted(spark, sf):
    return _allocated(spark, sf)


_ALLOC = rf"""{_SCRIPTS},
c AS (
  SELECT conv_id, turn, text AS line,
    CASE WHEN conv_id % 2 = 0 AND role <> 'user' THEN ((turn * 7) % 20)::DOUBLE END AS b,
    CASE WHEN turn % 3 > 0 THEN ((turn * 7) % 20 + 5)::DOUBLE END AS f FROM conv
  WHERE text <> ''),
w AS (
  SELECT *, greatest(CASE WHEN f > b THEN f - b ELSE 0 END, 0.8::DOUBLE,
    len(regexp_extract_all(line, '[^\s\p{{Z}}]+')) * 0.35::DOUBLE) AS w,
    coalesce(b, 1e9::DOUBLE) AS late FROM c),
r AS (
  SELECT *, row_number() OVER k AS i, sum(w) OVER (k ROWS UNBOUNDED PRECEDING) AS run,
    count(*) OVER (PARTITION BY conv_id) AS n, sum(w) OVER (PARTITION BY conv_id) AS tw
  FROM w WINDOW k AS (PARTITION BY conv_id ORDER BY late, turn)),
m AS (
  SELECT *, CASE WHEN n * 1.2::DOUBLE > {TOTAL} THEN greatest(0.1::DOUBLE, {TOTAL}::DOUBLE / n)
    ELSE 1.2::DOUBLE END AS lo FROM r),
x AS (
  SELECT *, CASE WHEN i = 1 THEN 0 ELSE least({TOTAL}::DOUBLE,
      lo * (i - 1) + greatest(0, {TOTAL}::DOUBLE - n * lo) * ((run - w) / tw)) END AS s,
    CASE WHEN i = n THEN {TOTAL}::DOUBLE ELSE least({TOTAL}::DOUBLE,
      lo * i + greatest(0, {TOTAL}::DOUBLE - n * lo) * (run / tw)) END AS e FROM m),
al AS (
  SELECT conv_id, i::BIGINT AS scene_index, round(s, 3) AS start_sec, round(e, 3) AS end_sec,
    CASE WHEN i = n THEN round({TOTAL}::DOUBLE - round(s, 3), 3) ELSE round(e - s, 3) END AS duration_sec,
    line FROM x{_stock()})
"""


def compress_groups(spark, sf):
    return S.join_pieces(S.compress_groups(_allocated(spark, sf), "conv_id", 3, F.lit(TOTAL), piece_size=120), "conv_id")


COMPRESS_SQL = "WITH " + _ALLOC + f""",
g0 AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM al),
g1 AS (SELECT *, CASE WHEN n > 3 THEN (n + 2) // 3 ELSE 1 END AS size FROM g0),
g2 AS (
  SELECT conv_id, (scene_index - 1) // size + 1 AS k, max(n) AS n, max((n + size - 1) // size) AS groups,
    sum(duration_sec) AS d, min(start_sec) AS s0, max(end_sec) AS e0,
    string_agg(line, ' ' ORDER BY scene_index) AS line FROM g1 GROUP BY 1, 2),
g3 AS (
  SELECT *, CASE WHEN d > 0 THEN d ELSE greatest(0.1, e0 - s0) END AS dur FROM g2),
g4 AS (
  SELECT *, sum(dur) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM g3)
SELECT conv_id, k::BIGINT AS scene_index,
  CASE WHEN n <= 3 THEN s0 ELSE round(least({TOTAL}::DOUBLE, run - dur), 3) END AS start_sec,
  CASE WHEN n <= 3 THEN e0 WHEN k = groups THEN {TOTAL}::DOUBLE
    ELSE round(least({TOTAL}::DOUBLE, run), 3) END AS end_sec,
  CASE WHEN n <= 3 THEN d WHEN k = groups
      THEN round({TOTAL}::DOUBLE - round(least({TOTAL}::DOUBLE, run - dur), 3), 3)
    ELSE round(least({TOTAL}::DOUBLE, run) - least({TOTAL}::DOUBLE, run - dur), 3) END AS duration_sec,
  '' AS focus, CASE WHEN line = '' AND n > 3 THEN '{FALLBACK_LINE}' ELSE line END AS line
FROM g4"""


# ---- timing ----------------------------------------------------------------------
_LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def timing_class(spark, sf):
    df = table(spark, sf, "lineitem")
    out = S.timing_class(df, F.col("l_quantity") + F.col("l_discount") * 40, F.col("l_quantity"))
    return out.select(*_LINE_ID[:1], F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                      *_LINE_ID[2:], "timing_reason", "coverage", "action", "goal_sec")


TIMING_SQL = """
WITH x AS (SELECT *, l_quantity + l_discount * 40 AS raw, l_quantity AS v FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
  CASE WHEN raw > v + 2.8::DOUBLE THEN 'above_max_overrun' WHEN raw < v + 0.8::DOUBLE THEN 'below_min_overrun'
    WHEN raw >= v + 2.0::DOUBLE THEN 'within_range_above_preferred'
    WHEN raw > v THEN 'within_range_below_preferred' ELSE 'at_or_below_video_duration' END AS timing_reason,
  round(raw / greatest(0.001::DOUBLE, v), 3) AS coverage,
  CASE WHEN raw > v + 2.8::DOUBLE THEN 'speed_to_max' WHEN raw < v + 0.8::DOUBLE THEN 'pad_to_min'
    ELSE 'keep' END AS action,
  round(CASE WHEN raw > v + 2.8::DOUBLE THEN v + 2.8::DOUBLE WHEN raw < v + 0.8::DOUBLE
    THEN v + 0.8::DOUBLE ELSE raw END, 3) AS goal_sec FROM x"""


def label_by_windows(spark, sf):
    """Lines of an order against delivery windows of its part's supplier, in days of the year."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "l_suppkey",
        F.dayofyear("l_shipdate").alias("day"),
    )
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    no = F.col("l_suppkey")
    windows = s.select(no, (no % 200).alias("begin"), (no % 90 * 3).alias("end")).union(
        s.where(no % 3 == 0).select(no, F.lit(330), F.lit(-1))
    ).where(no % 5 != 0)
    return S.label_by_windows(lines, F.col("day"), windows, "l_suppkey").drop("day")


LABEL_BY_SQL = """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
  l_suppkey % 5 <> 0 AND (dayofyear(l_shipdate) BETWEEN l_suppkey % 200 AND greatest(l_suppkey % 200, l_suppkey % 90 * 3)
    OR (l_suppkey % 3 = 0 AND dayofyear(l_shipdate) >= 330)) AS labelled
FROM lineitem"""


def label_windows(spark, sf):
    second = (epoch_micros("ts") % 86_400_000_000) / F.lit(1e6)
    out = S.label_windows(table(spark, sf, "events"), second, [(0, 3600), (43_200, 50_000), (80_000, -1)])
    return out.select("event_id", "labelled")


LABEL_SQL = """
SELECT event_id, (s BETWEEN 0 AND 3600 OR s BETWEEN 43200 AND 50000 OR s >= 80000) AS labelled
FROM (SELECT event_id, (epoch_us(ts) % 86400000000) / 1e6 AS s FROM events)"""


# ---- reach -----------------------------------------------------------------------
def reach(spark, sf):
    """Pages within three shared links of the first page."""
    pages = table(spark, sf, "pages")
    links = pages.select(
        "page_id", F.explode(extract_all(F.col("html"), r'(?is)<a\b[^>]*href="([^"]*)"')).alias("href")
    )
    first = pages.agg(F.concat(F.lit("s:"), F.min("page_id").cast("string")).alias("node"))
    found = G.reach(G.shared_target_edges(links, "page_id", "href"), first, 6)
    return found.filter(F.col("node").startswith("s:")).select(
        F.substring("node", 3, 20).cast("bigint").alias("page_id"),
        (F.col("depth") / 2).cast("bigint").alias("depth"),
        S.crawl_priority(F.col("depth") / 2).cast("bigint").alias("priority"),
    )


REACH_SQL = r"""
WITH RECURSIVE l AS (
  SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"', 1)) AS h FROM pages),
e AS (SELECT 's:' || page_id AS src, 't:' || h AS dst FROM l
      UNION ALL SELECT 't:' || h, 's:' || page_id FROM l),
r(node, d) AS (
  SELECT 's:' || (SELECT min(page_id) FROM pages), 0
  UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.node WHERE r.d < 6)
SELECT node[3:]::BIGINT AS page_id, (min(d) // 2)::BIGINT AS depth,
  greatest(1000 - 10 * (min(d) // 2), 0)::BIGINT AS priority
FROM r WHERE starts_with(node, 's:') GROUP BY node"""

QUERIES = {
    f.__name__: f
    for f in (
        interleave, counter_rates, ewma, load_class, split_even, allocate_weighted, compress_groups,
        timing_class, label_windows, label_by_windows, reach,
    )
}
SQL = {
    "interleave": INTERLEAVE_SQL,
    "counter_rates": "WITH " + _TICKS
    + "SELECT event_id, round(rps, 6) AS rps, round(error_rate, 6) AS error_rate FROM r",
    "ewma": "WITH " + _TICKS + "SELECT event_id, round(smoothed, 6) AS smoothed FROM s",
    "load_class": LOAD_SQL,
    "split_even": SPLIT_EVEN_SQL,
    "allocate_weighted": "WITH " + _ALLOC + "SELECT * FROM al",
    "compress_groups": COMPRESS_SQL,
    "timing_class": TIMING_SQL,
    "label_windows": LABEL_SQL,
    "label_by_windows": LABEL_BY_SQL,
    "reach": REACH_SQL,
}
