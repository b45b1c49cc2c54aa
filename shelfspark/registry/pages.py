"""Page-mining queries. The stored test pages carry none of the default markup,
so the profiles below name markup they do have; the rules stay the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from shelfspark.operators import aggregates as A
from shelfspark.operators import pages as P
from shelfspark.operators import queues as Q
from shelfspark.profiles import LinkProfile, PageProfile, UrlProfile
from shelfspark.registry.base import canonical, lit, path, table

LINKS = LinkProfile(
    nav_pattern=r"(?is)<nav\b[^>]*>.*?</nav>", href_contains="/", list_class="", up_class="none"
)
ANY_SITE = UrlProfile(domain="", listing_prefix="", page_param="page")
ITEM_SITE = UrlProfile(
    item_id="[A-Z]{4,6}",
    item_patterns=("/(th[a-z]+)",),
    page_param="page",
    page_path_pattern=r"/([0-9]+)\.html",
    listing_prefix="/en",
)
MARKUP = PageProfile(
    title_patterns=(r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title>(.*?)</title>"),
    title_suffix=r"(?i)\s*%%%.*$",
    points_markers=("<nav>", "<ul>"),
    point_skip_prefix="the",
    meta_pattern=r'(?is)<div class="ad">(.*?)</div>',
    media_json_pattern=r'(?i)"pageURL"\s*:\s*"([^"]+)"',
    media_url_pattern=r"(?i)free-[a-z]+|spam-[a-z]+",
    presence_marker="<article>",
    thumb_pattern=r"(?i)<b>",
    action_pattern=r"(?i)\*\*\* ",
    count_pattern=r"(?i)([0-9]+)</p>",
    blocked_phrases=("casino", "&amp;&amp;&amp; ", "free-bets"),
    item_attr_pattern=r'(?is)href="/([^"]*)"',
    card_link_class="",
    next_link_patterns=(r'(?is)<a href="(/for)"', r'(?is)<a href="(/and)"'),
    pagination_pattern=r"(?is)<nav>(.*(?:/in|/of).*?)</nav>",
    page_link_pattern=r'(?is)<li><a href="([^"]*)"',
)


def _pages(spark, sf):
    return table(spark, sf, "pages")


# ---- SQL fragments ----------------------------------------------------------
def strip_sql(text: str) -> str:
    for pattern in (
        r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>", "<[^>]+>",
    ):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return text


# Every entity of the test pages; a cut-off "&am" is not one.
ENTITIES = (
    ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
    ("&amp;", "&"),
)


def decode_sql(text: str) -> str:
    for entity, char in ENTITIES:
        text = f"replace({text}, '{entity}', '{char}')"
    # "&amp" without the semicolon decodes as well.
    return f"replace({text}, '&amp', '&')"


def clean_sql(text: str) -> str:
    return (
        f"trim(regexp_replace({decode_sql(strip_sql(text))}, "
        r"'[\s\p{Z}\x{85}\x{200e}\x{200f}\x0b]+', ' ', 'g'))"
    )


# ---- clean text ---------------------------------------------------------------
def clean_html(spark, sf):
    return P.clean_html(_pages(spark, sf)).select("page_id", "clean_text")


CLEAN_SQL = f"SELECT page_id, {clean_sql('html')} AS clean_text FROM pages"


# ---- links --------------------------------------------------------------------
LINK_COLUMNS = ["page_id", "pos", "branch_name", "branch_url", "source_page", "depth",
                "is_up_link", "cluster_key"]


def page_links(spark, sf):
    found = P.page_links(_pages(spark, sf), LINKS, ANY_SITE, in_scope_only=False)
    return found.select(*LINK_COLUMNS).withColumn("pos", F.col("pos").cast("bigint"))


def extract_links(spark, sf):
    found = P.extract_links(_pages(spark, sf), LINKS, ANY_SITE, in_scope_only=False)
    return found.select(*LINK_COLUMNS).withColumn("pos", F.col("pos").cast("bigint"))


_ORIGIN = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
LINK_TOKENS_SQL = rf"""
WITH n AS (
  SELECT page_id, url, regexp_extract_all(regexp_extract(html, '(?is)<nav\b[^>]*>.*?</nav>'),
    '(?is)<(?:a\b[^>]*>.*?</a\s*>|/?(?:li|ol|ul)\b[^>]*>)') AS tags FROM pages),
t AS (
  SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM n),
d AS (
  SELECT *, sum(CASE WHEN starts_with(tag, '<ul') THEN 1 WHEN starts_with(tag, '</ul') THEN -1
    ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS lists FROM t),
l AS (
  SELECT page_id, pos, {clean_sql('tag')} AS branch_name,
    {canonical(_ORIGIN + " || regexp_extract(tag, 'href=" + '"([^"]*)"' + "', 1)")} AS branch_url,
    {canonical('url')} AS source_page, greatest(lists - 1, 0)::BIGINT AS depth,
    false AS is_up_link
  FROM d WHERE starts_with(tag, '<a')),
k AS (
  SELECT *, list_filter(string_split({path('branch_url')}, '/'), lambda s: s <> '') AS s FROM l),
links AS (
  SELECT page_id, pos::BIGINT AS pos, branch_name, branch_url, source_page, depth, is_up_link,
    CASE WHEN len(s) >= 2 AND regexp_matches(s[2], '^[0-9]+$') THEN s[2]
         WHEN len(s) >= 1 THEN s[1] ELSE 'root' END AS cluster_key FROM k),
firsts AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY branch_url ORDER BY page_id, pos) AS rn FROM links) WHERE rn = 1)
"""


def depth_distribution(spark, sf):
    return A.distribution(P.page_links(_pages(spark, sf), LINKS, ANY_SITE, in_scope_only=False), "depth")


def filter_links(spark, sf):
    found = P.page_links(_pages(spark, sf), LINKS, ANY_SITE, in_scope_only=False)
    marked = found.withColumn("is_up_link", F.col("branch_name").startswith("the"))
    kept = Q.filter_branches(marked, order=("page_id", "pos"))
    return kept.select("page_id", F.col("pos").cast("bigint").alias("pos"), "branch_url")


FILTER_LINKS_SQL = LINK_TOKENS_SQL + """
SELECT page_id, pos, branch_url FROM (
  SELECT *, row_number() OVER (PARTITION BY branch_url ORDER BY page_id, pos) AS rn
  FROM links WHERE NOT starts_with(branch_name, 'the')) WHERE rn = 1"""


# ---- items ----------------------------------------------------------------------
def item_ids(spark, sf):
    return P.extract_item_ids(_pages(spark, sf), MARKUP, ITEM_SITE)


ITEM_IDS_SQL = rf"""
WITH a AS (
  SELECT page_id, url, regexp_extract_all(html, '(?is)href="/([^"]*)"', 1) AS h FROM pages),
u AS (SELECT page_id, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM a),
linked AS (
  SELECT page_id, 'https://shop.example/dp/' || upper(regexp_extract('/' || h, '(?i)/(th[a-z]+)', 1))
    AS item_url, 0 AS grp, min(i)::VARCHAR AS o, min(i) AS n
  FROM u WHERE regexp_matches('/' || h, '(?i)/th[a-z]+') GROUP BY 1, 2),
ids AS (
  SELECT DISTINCT page_id, 'https://shop.example/dp/' || upper(replace(trim(h), 'ß', 'ss')) AS item_url, 1 AS grp,
    upper(replace(trim(h), 'ß', 'ss')) AS o, 0 AS n
  FROM u WHERE regexp_matches(upper(replace(trim(h), 'ß', 'ss')), '^[A-Z]{{4,6}}$')),
al AS (SELECT * FROM linked UNION ALL SELECT * FROM ids i WHERE NOT EXISTS (
  SELECT 1 FROM linked l WHERE l.page_id = i.page_id AND l.item_url = i.item_url))
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY grp, n, o) - 1)::BIGINT AS pos,
  item_url FROM al"""


# ---- fields, media, presence ----------------------------------------------------
FIELD_COLUMNS = ["page_id", "title", "description"]


def page_fields(spark, sf):
    out = P.extract_fields(_pages(spark, sf), MARKUP)
    return out.select("page_id", "title", F.size("points").cast("bigint").alias("n_points"), "description")


def fields_ctes(source: str) -> str:
    """CTE f(page_id, title, n_points, description) over ``source``(page_id, html)."""
    return rf"""
t0 AS (
  SELECT page_id, html, regexp_matches(html, '(?is)<h1[^>]*>(.*?)</h1>') AS strong,
    CASE WHEN regexp_matches(html, '(?is)<h1[^>]*>(.*?)</h1>')
      THEN regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)
      ELSE regexp_extract(html, '(?is)<title>(.*?)</title>', 1) END AS tt,
    CASE WHEN strpos(html, '<nav>') > 0
      THEN substr(html, strpos(html, '<nav>'))
      WHEN strpos(html, '<ul>') > 0 THEN substr(html, strpos(html, '<ul>'))
      ELSE '' END AS block,
    regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1) AS meta FROM {source}),
p0 AS (
  SELECT page_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (
    SELECT page_id, regexp_extract_all(block, '(?is)<li[^>]*>(.*?)</li>', 1) AS x FROM t0)),
p1 AS (
  SELECT page_id, {clean_sql('p')} AS p, i FROM p0),
p2 AS (
  SELECT page_id, p, min(i) AS i FROM p1
  WHERE p <> '' AND NOT starts_with(lower(p), 'the') GROUP BY page_id, p),
p3 AS (
  SELECT page_id, string_agg(p, ' | ' ORDER BY i) AS description, count(*) AS n FROM p2 GROUP BY page_id),
f AS (
  SELECT t0.page_id,
    CASE WHEN strong THEN {clean_sql('tt')}
      ELSE regexp_replace({clean_sql('tt')}, '(?i)\s*%%%.*$', '') END AS title,
    CASE WHEN p3.n IS NOT NULL THEN p3.n WHEN {clean_sql('meta')} <> '' THEN 1 ELSE 0 END AS n_points,
    coalesce(p3.description, {clean_sql('meta')}) AS description
  FROM t0 LEFT JOIN p3 ON t0.page_id = p3.page_id)"""


PAGE_FIELDS_SQL = (
    "WITH " + fields_ctes("pages") + " SELECT page_id, title, n_points::BIGINT AS n_points, description FROM f"
)

# Media: "URLs" of the test pages are their own absolute host references.
MEDIA = replace(
    MARKUP,
    media_json_pattern=r'(?i)href="(/[^"]*)"',
    media_url_pattern=r"""(?i)https?:[\\/]+[^"'\s<>]+?\.(?:com|net)(?:[^"'\s<>]*)""",
    media_suffixes=(".example.com", ".example.net", "/th"),
)


def _embedded(spark, sf):
    """Pages with their own URL written into the body twice, once escaped, as
    script data does it; the stored bodies hold no absolute URL themselves."""
    data = F.concat(
        F.lit('<script>{"u":"'), F.col("url"), F.lit('","v":"'),
        F.regexp_replace("url", "/", r"\\/"), F.lit('"}</script>'),
    )
    return _pages(spark, sf).withColumn("html", F.concat("html", data))


def media_urls(spark, sf):
    out = P.extract_media(_embedded(spark, sf), MEDIA)
    return out.select(
        "page_id",
        F.size("media_urls").cast("bigint").alias("n_media"),
        F.array_join("media_urls", " ").alias("media_urls"),
    )


MEDIA_URLS_SQL = """
SELECT page_id, count(url)::BIGINT AS n_media, coalesce(max(url), '') AS media_urls FROM (
  SELECT page_id, CASE WHEN contains(lower(url), '.example.com')
    OR contains(lower(url), '.example.net') THEN url END AS url FROM pages)
GROUP BY page_id"""


def page_signals(spark, sf):
    out = P.detect_presence(P.extract_media(_pages(spark, sf), MARKUP), MARKUP)
    return out.select(
        "page_id", "has_video", "video_count", F.array_join("signals", ",").alias("signals")
    )


def presence_ctes(source: str) -> str:
    """CTE s(page_id, has_video, video_count, signals) over ``source``(page_id, html)."""
    return rf"""
b0 AS (
  SELECT page_id, CASE WHEN strpos(html, '<article>') > 0
    THEN substr(html, strpos(html, '<article>')) ELSE html END AS b FROM {source}),
b1 AS (
  SELECT page_id, regexp_matches(b, '(?i)<b>') AS thumb, regexp_matches(b, '(?i)\*\*\* ') AS act,
    regexp_matches(b, '(?i)([0-9]+)</p>') AS lab,
    try_cast(regexp_extract(b, '(?i)([0-9]+)</p>', 1) AS BIGINT) AS n_lab,
    len(regexp_extract_all(b, '(?i)<b>')) AS hits FROM b0),
b2 AS (
  SELECT *, CASE WHEN lab THEN n_lab WHEN thumb OR act THEN greatest(1, hits) ELSE 0 END AS n FROM b1),
s AS (
  SELECT page_id, (thumb OR act OR n > 0) AS has_video,
    CASE WHEN (thumb OR act OR n > 0) AND n = 0 THEN 1 ELSE n END::BIGINT AS video_count,
    concat_ws(',', CASE WHEN thumb THEN 'videoThumbnail-class' END,
      CASE WHEN act THEN 'openVideoImmersiveView/chromeful-video' END,
      CASE WHEN lab THEN 'videoCount-label' END) AS signals FROM b2)"""


PAGE_SIGNALS_SQL = (
    "WITH " + presence_ctes("pages") + " SELECT page_id, has_video, video_count, signals FROM s"
)


def blocked_pages(spark, sf):
    return P.classify_blocked(_pages(spark, sf), MARKUP).select("page_id", "blocked", "error")


_BLOCKED = " OR ".join(f"contains(lower(html), {lit(p)})" for p in MARKUP.blocked_phrases)
BLOCKED_SQL = f"""
SELECT page_id, ({_BLOCKED}) AS blocked,
  CASE WHEN {_BLOCKED} THEN 'Bot challenge / captcha page returned' ELSE '' END AS error FROM pages"""


def _results(spark, sf):
    return P.page_results(_pages(spark, sf), MARKUP, ITEM_SITE)


def page_results(spark, sf):
    return _results(spark, sf).select(
        "page_id", "url", "title", "description", "has_video", "video_count",
        F.array_join("signals", ",").alias("signals"), "blocked", "error",
    )


RESULTS_CTES = (
    f"WITH ok AS (SELECT page_id, html FROM pages WHERE NOT ({_BLOCKED})),"
    + fields_ctes("ok") + "," + presence_ctes("ok")
    + f""",
r AS (
  SELECT p.page_id, p.url, coalesce(f.title, '') AS title, coalesce(f.description, '') AS description,
    coalesce(s.has_video, false) AS has_video, coalesce(s.video_count, 0)::BIGINT AS video_count,
    coalesce(s.signals, '') AS signals, ({_BLOCKED}) AS blocked,
    CASE WHEN {_BLOCKED} THEN 'Bot challenge / captcha page returned' ELSE '' END AS error
  FROM pages p LEFT JOIN f ON p.page_id = f.page_id LEFT JOIN s ON p.page_id = s.page_id)
"""
)


def summary(spark, sf):
    """Canonical URL -> first-seen dedupe -> page results -> counts."""
    from shelfspark.functions.urls import canonical_section

    unique = Q.dedupe_first(_pages(spark, sf), canonical_section("url"), ["page_id"], "key")
    return A.summarize(P.page_results(unique, MARKUP, ITEM_SITE))


SUMMARY_SQL = (
    RESULTS_CTES
    + f""", k AS (
  SELECT *, row_number() OVER (PARTITION BY {canonical('url')} ORDER BY page_id) AS rn FROM r)
SELECT count(*)::BIGINT AS total, count(*) FILTER (has_video)::BIGINT AS with_video,
  count(*) FILTER (NOT has_video)::BIGINT AS without_video,
  count(*) FILTER (blocked)::BIGINT AS blocked, count(*) FILTER (error <> '')::BIGINT AS page_errors,
  0::BIGINT AS downloaded_products, 0::BIGINT AS downloaded_videos, 0::BIGINT AS download_errors
FROM k WHERE rn = 1"""
)


def outcomes(spark, sf):
    """Summary of pages of which one in nine could not be fetched, with what became of
    their media: every page's own URL was tried, one in four with an error."""
    pages = _embedded(spark, sf)
    n = F.col("page_id")
    downloads = pages.select(
        "url", F.col("url").alias("video_url"), F.concat(F.lit("f"), n).alias("path"),
        F.when(n % 4 == 0, F.lit(" 404 ")).alias("error"),
    )
    unique = Q.dedupe_first(pages, F.col("url"), ["page_id"], "key")
    first = downloads.join(unique.select("url"), "url", "left_semi").dropDuplicates(["url", "path"])
    results = P.page_results(unique, MEDIA, ITEM_SITE, fetch_error=F.when(n % 9 == 2, F.lit("timeout")), downloads=first)
    return A.summarize(results.withColumn("has_video", F.size("video_urls") > 0))


OUTCOMES_SQL = f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages),
r AS (
  SELECT url, page_id % 9 = 2 AS failed, page_id % 9 <> 2 AND ({_BLOCKED}) AS blocked,
    contains(lower(url), '.example.com') OR contains(lower(url), '.example.net') AS media FROM k WHERE rn = 1),
d AS (SELECT url, count(*) FILTER (page_id % 4 <> 0) AS good, count(*) FILTER (page_id % 4 = 0) AS bad FROM pages GROUP BY url)
SELECT count(*)::BIGINT AS total, count(*) FILTER (media AND NOT blocked AND NOT failed)::BIGINT AS with_video,
  count(*) FILTER (NOT media OR blocked OR failed)::BIGINT AS without_video, count(*) FILTER (blocked)::BIGINT AS blocked,
  count(*) FILTER (blocked OR failed)::BIGINT AS page_errors, count(*) FILTER (good > 0)::BIGINT AS downloaded_products,
  sum(good)::BIGINT AS downloaded_videos, sum(bad)::BIGINT AS download_errors
FROM r JOIN d ON r.url = d.url"""


REPORT_SQL = RESULTS_CTES + """
SELECT count(*)::BIGINT AS total, count(*) FILTER (has_video)::BIGINT AS with_video,
  count(*) FILTER (NOT has_video)::BIGINT AS without_video,
  count(*) FILTER (blocked)::BIGINT AS blocked, count(*) FILTER (error <> '')::BIGINT AS page_errors,
  0::BIGINT AS downloaded_products, 0::BIGINT AS downloaded_videos, 0::BIGINT AS download_errors FROM r"""


# ---- pagination -------------------------------------------------------------------
def next_pages(spark, sf):
    out = P.next_page_edges(_pages(spark, sf), MARKUP, ITEM_SITE)
    return out.select("page_id", "branch_url", "page_no", "page_url", "via")


_CUR = r"""coalesce(
    try_cast(nullif(regexp_extract(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)page=([^&]+)', 1), '') AS BIGINT),
    try_cast(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/([0-9]+)\.html', 1), '') AS BIGINT), 1)"""
NEXT_SQL = rf"""
WITH p AS (
  SELECT page_id, url, html, {canonical('url', False)} AS branch_url, {_CUR} AS cur,
    {_ORIGIN} AS origin,
    regexp_extract(html, '(?is)(?:(?is)<a href="(/for)")|(?:(?is)<a href="(/and)")', 0) AS nx,
    regexp_matches(html, '(?is)<nav>(.*(?:/in|/of).*?)</nav>') AS paged,
    len(list_filter(regexp_extract_all(html, '(?is)href="/([^"]*)"', 1), lambda h:
      regexp_matches('/' || h, '(?i)/th[a-z]+') OR regexp_matches(upper(replace(trim(h), 'ß', 'ss')), '^[A-Z]{{4,6}}$'))) > 0
      AS items FROM pages),
e AS (
  SELECT page_id, branch_url, cur, 1::BIGINT AS page_no,
    origin || regexp_extract(nx, 'href="([^"]*)"', 1) AS page_url, 'next' AS via
  FROM p WHERE nx <> ''
  UNION ALL
  SELECT page_id, branch_url, cur, cur + 1,
    CASE WHEN {path('branch_url')} = '' THEN branch_url || '/en' ELSE branch_url END
    || '/ref=zg_bs_pg_' || (cur + 1) || '_' || lower(coalesce(nullif(regexp_extract({path('url')},
      '(?i)/en/([^/?#]+)', 1), ''), 'kitchen')) || '?ie=UTF8&pg=' || (cur + 1), 'onward'
  FROM p WHERE nx = '' AND NOT paged AND items)
SELECT page_id, branch_url, page_no, page_url, via FROM (
  SELECT *, row_number() OVER (PARTITION BY branch_url, page_no ORDER BY cur, page_id, page_url) AS rn
  FROM e) WHERE rn = 1"""

QUERIES = {
    "clean_html": clean_html,
    "page_links": page_links,
    "extract_links": extract_links,
    "depth_distribution": depth_distribution,
    "filter_links": filter_links,
    "item_ids": item_ids,
    "page_fields": page_fields,
    "media_urls": media_urls,
    "page_signals": page_signals,
    "blocked_pages": blocked_pages,
    "page_results": page_results,
    "summary": summary,
    "outcomes": outcomes,
    "next_pages": next_pages,
}
SQL = {
    "clean_html": CLEAN_SQL,
    "page_links": LINK_TOKENS_SQL + "SELECT * FROM links",
    "extract_links": LINK_TOKENS_SQL + "SELECT * FROM firsts",
    "depth_distribution": LINK_TOKENS_SQL
    + "SELECT depth, count(*)::BIGINT AS n FROM links GROUP BY depth",
    "filter_links": FILTER_LINKS_SQL,
    "item_ids": ITEM_IDS_SQL,
    "page_fields": PAGE_FIELDS_SQL,
    "media_urls": MEDIA_URLS_SQL,
    "page_signals": PAGE_SIGNALS_SQL,
    "blocked_pages": BLOCKED_SQL,
    "page_results": RESULTS_CTES + "SELECT * FROM r",
    "summary": SUMMARY_SQL,
    "outcomes": OUTCOMES_SQL,
    "next_pages": NEXT_SQL,
}
