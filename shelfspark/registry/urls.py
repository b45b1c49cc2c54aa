"""URL queries over the page table and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import urls as U
from shelfspark.operators import urls as O
from shelfspark.profiles import UrlProfile
from shelfspark.registry.base import canonical, lit, part, path, table

# The test site: /<lang>/<number>[.html], ?page=, hosts under three domains.
SITE = UrlProfile(
    domain="example.com",
    item_prefix="https://shop.example/dp/",
    item_id="[0-9]{3}",
    item_patterns=("/en/([0-9]{3})", "/(?:de|fr|es)/([0-9]{3})"),
    key_pattern="(?i)/(?:en|de)/([0-9]{2})",
    listing_prefix="/fr",
    default_section="kitchen",
    page_param="page",
    page_path_pattern=r"/([0-9]+)\.html",
)
ROOT_SITE = UrlProfile(listing_prefix="", page_param="page", page_path_pattern=r"/([0-9]+)\.html")


def canonical_url(spark, sf):
    df = O.canonicalize_urls(table(spark, sf, "pages"))
    df = O.canonicalize_urls(df, form="section_bare", out="canonical_bare")
    return df.select("page_id", "canonical_url", "canonical_bare")


CANONICAL_SQL = f"""
SELECT page_id, {canonical('url')} AS canonical_url, {canonical('url', False)} AS canonical_bare
FROM pages"""


def item_url(spark, sf):
    df = O.canonicalize_urls(table(spark, sf, "pages"), form="item", out="item_url", profile=SITE)
    return df.select("page_id", "item_url")


ITEM_URL_SQL = f"""
SELECT page_id, CASE
  WHEN regexp_matches({path('url')}, '/en/[0-9]{{3}}')
    THEN 'https://shop.example/dp/' || regexp_extract({path('url')}, '/en/([0-9]{{3}})', 1)
  WHEN regexp_matches({path('url')}, '/(?:de|fr|es)/[0-9]{{3}}')
    THEN 'https://shop.example/dp/' || regexp_extract({path('url')}, '/(?:de|fr|es)/([0-9]{{3}})', 1)
  ELSE 'https://' || lower({part('url', 2)}) || {part('url', 3)} END AS item_url
FROM pages"""


def item_key(spark, sf):
    df = table(spark, sf, "pages")
    df = O.item_key(df, "url", "url", "url_key", profile=SITE)
    last = F.regexp_extract("url", r"/([^/?#]*)[^/]*$", 1)
    df = O.item_key(df, last, "strict", "strict_key", profile=SITE)
    df = O.item_key(df, "url", "text", "text_key", profile=UrlProfile())
    return df.select("page_id", "url_key", "strict_key", "text_key")


ITEM_KEY_SQL = r"""
SELECT page_id,
  upper(regexp_extract(url, '(?i)/(?:en|de)/([0-9]{2})', 1)) AS url_key,
  CASE WHEN regexp_matches(regexp_extract(url, '/([^/?#]*)[^/]*$', 1), '^[0-9]{3}$')
    THEN regexp_extract(url, '/([^/?#]*)[^/]*$', 1) ELSE '' END AS strict_key,
  regexp_extract(upper(url), '(?:^|[^\p{L}\p{N}_])([A-Z0-9]{10})(?:$|[^\p{L}\p{N}_])', 1) AS text_key
FROM pages"""


def url_attributes(spark, sf):
    df = O.url_attributes(table(spark, sf, "pages"), profile=SITE)
    cluster_root = U.cluster_key("url", ROOT_SITE)
    return df.select(
        "page_id", "page_no", "section", "section_raw",
        F.col("cluster_key").alias("cluster_fr"), cluster_root.alias("cluster_root"),
    )


ATTRIBUTES_SQL = rf"""
WITH p AS (
  SELECT page_id, {part('url', 4)} AS q, {path('url')} AS p,
    list_filter(string_split({path('url')}, '/'), lambda s: s <> '') AS s
  FROM pages)
SELECT page_id,
  coalesce(try_cast(nullif(regexp_extract(q, '(?:^|&)page=([^&]+)', 1), '') AS BIGINT),
           try_cast(nullif(regexp_extract(p, '/([0-9]+)\.html', 1), '') AS BIGINT), 1) AS page_no,
  lower(coalesce(nullif(regexp_extract(p, '(?i)/fr/([^/?#]+)', 1), ''), 'kitchen')) AS section,
  CASE WHEN list_position(s, 'fr') > 0 THEN s[list_position(s, 'fr') + 1] END AS section_raw,
  CASE WHEN s[1] = 'fr' AND len(s) >= 3 AND regexp_matches(s[3], '^[0-9]+$') THEN s[3]
       WHEN s[1] = 'fr' AND len(s) >= 2 THEN s[2] ELSE 'root' END AS cluster_fr,
  CASE WHEN len(s) >= 2 AND regexp_matches(s[2], '^[0-9]+$') THEN s[2]
       WHEN len(s) >= 1 THEN s[1] ELSE 'root' END AS cluster_root
FROM p"""


def expand_pages(spark, sf):
    df = O.expand_pages(table(spark, sf, "pages"), 3, profile=SITE)
    return df.select("page_id", "page", "page_url")


EXPAND_SQL = f"""
SELECT page_id, n AS page,
  CASE WHEN {path(canonical('url', False))} = ''
       THEN {canonical('url', False)} || '/fr' ELSE {canonical('url', False)} END
  || '/ref=zg_bs_pg_' || n || '_'
  || lower(coalesce(nullif(regexp_extract({path('url')}, '(?i)/fr/([^/?#]+)', 1), ''), 'kitchen'))
  || '?ie=UTF8&pg=' || n AS page_url
FROM pages, (SELECT unnest([1, 2, 3])::BIGINT AS n)"""


def set_query_param(spark, sf):
    df = table(spark, sf, "pages").withColumn(
        "link", F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?", "ftp"))
        .when(F.col("page_id") % 7 == 1, F.regexp_replace("url", r"\?", "?a+b=%C3%A9*&&x=~&REF=2&"))
        .otherwise(F.col("url"))
    )
    out = O.set_query_param(df, "link", "ref", "s 21&t")
    return out.select("page_id", "new_url", "rejected")


SET_QUERY_SQL = rf"""
WITH l AS (
  SELECT page_id, CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '^https?', 'ftp')
    WHEN page_id % 7 = 1 THEN replace(url, '?', '?a+b=%C3%A9*&&x=~&REF=2&') ELSE url END AS u
  FROM pages),
s AS (
  SELECT page_id, u, {part('u', 1)} AS sch, {part('u', 4)} AS q, {part('u', 5)} AS f FROM l),
kv AS (
  SELECT page_id, i, url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')) AS k,
    url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' ')) AS v
  FROM (SELECT page_id, unnest(string_split(q, '&')) AS p,
          generate_subscripts(string_split(q, '&'), 1) AS i FROM s)
  WHERE p <> ''),
j AS (
  SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '='
      || replace(url_encode(v), '%20', '+') || '&', '' ORDER BY i) AS kept
  FROM kv WHERE lower(k) <> 'ref' GROUP BY page_id)
SELECT s.page_id,
  CASE WHEN sch IN ('http', 'https') THEN sch || '://' || {part('u', 2)} || {part('u', 3)}
    || '?' || coalesce(kept, '') || 'ref=s+21%26t' || CASE WHEN f <> '' THEN '#' || f ELSE '' END
  END AS new_url,
  CASE WHEN sch NOT IN ('http', 'https') THEN 'scheme is not http(s)' END AS rejected
FROM s LEFT JOIN j ON s.page_id = j.page_id"""

# One href of every kind a page may carry.
HREFS = (
    "//cdn.example/x/y", "?q=1", "#frag", "next.html", "../up/./a//b", "/abs/../c/.", "..",
    "http://other.example/z", "/plain?x=1#y", "./", "a/b/../../..",
)


def resolve_links(spark, sf):
    hrefs = F.array(*[F.lit(h) for h in HREFS])
    df = table(spark, sf, "pages").select("page_id", "url", F.explode(hrefs).alias("href"))
    return O.resolve_links(df, "url", "href").select("page_id", "href", "absolute_url")


RESOLVE_SQL = rf"""
WITH h AS (SELECT page_id, url, unnest([{', '.join(lit(h) for h in HREFS)}]) AS href FROM pages),
s AS (
  SELECT page_id, href, url, lower({part('url', 1)}) AS bs, {part('url', 2)} AS bh,
    {part('url', 3)} AS bp, {part('url', 4)} AS bq, lower({part('href', 1)}) AS hs,
    {part('href', 2)} AS hh, {part('href', 3)} AS hp, {part('href', 4)} AS hq,
    {part('href', 5)} AS hf FROM h),
j AS (
  SELECT *, CASE WHEN starts_with(hp, '/') THEN string_split(hp, '/')
    ELSE list_concat(string_split(regexp_replace(bp, '/[^/]*$', ''), '/'), string_split(hp, '/'))
    END AS segs FROM s),
t AS (
  SELECT *, CASE WHEN starts_with(hp, '/') THEN segs ELSE
    list_filter(segs, lambda x, i: x <> '' OR i = 1 OR i = len(segs)) END AS tidy FROM j),
w AS (
  SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(tidy, lambda x: [x])),
    lambda acc, x: CASE WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)]
      WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END) AS walked FROM t),
d AS (
  SELECT *, array_to_string(CASE WHEN tidy[len(tidy)] IN ('.', '..')
      THEN list_append(walked, '') ELSE walked END, '/') AS np0 FROM w),
e AS (
  SELECT *, CASE WHEN np0 = '' THEN '/' WHEN starts_with(np0, '/') THEN np0
    ELSE '/' || np0 END AS np FROM d)
SELECT page_id, href, CASE
  WHEN hs <> '' AND hs <> bs THEN href
  WHEN hh <> '' THEN CASE WHEN hs <> '' THEN href ELSE bs || ':' || href END
  ELSE bs || '://' || bh || CASE WHEN hp = '' THEN bp ELSE np END
    || CASE WHEN hp = '' AND hq = '' THEN CASE WHEN bq <> '' THEN '?' || bq ELSE '' END
            WHEN hq <> '' THEN '?' || hq ELSE '' END
    || CASE WHEN hf <> '' THEN '#' || hf ELSE '' END END AS absolute_url
FROM e"""


def scope_filter(spark, sf):
    site = UrlProfile(domain="example.com", listing_prefix="/fr")
    wide = O.filter_scope(table(spark, sf, "pages"), root="1", follow_others=True, profile=site)
    narrow = O.filter_scope(table(spark, sf, "pages"), root="1", profile=site)
    return wide.select("page_id", F.lit("wide").alias("scope")).unionByName(
        narrow.select("page_id", F.lit("narrow").alias("scope"))
    )


SCOPE_SQL = f"""
WITH p AS (SELECT page_id, lower({part('url', 2)}) AS h, {path('url')} AS p FROM pages)
SELECT page_id, 'wide' AS scope FROM p
WHERE h LIKE '%example.com' AND contains(p, '/fr') AND p <> '/fr'
UNION ALL
SELECT page_id, 'narrow' AS scope FROM p
WHERE h LIKE '%example.com' AND starts_with(p, '/fr') AND contains(p, '/fr/1') AND p <> '/fr'"""


def media_clean(spark, sf):
    """Page URLs written the way pages embed media references, then cleaned."""
    escaped = F.regexp_replace("url", "/", r"\\/")
    embedded = F.array(
        F.concat(F.lit('"'), escaped, F.lit("),\"")),
        F.concat(F.col("url"), F.lit(r"&a=1&amp;b=2]\\")),
        F.lit("javascript:void(0)"),
    )
    df = table(spark, sf, "pages").withColumn("refs", embedded)
    out = O.clean_media_urls(df, "refs")
    return out.select("page_id", F.posexplode("media_urls").alias("pos", "media_url")).withColumn(
        "pos", F.col("pos").cast("bigint")
    )


MEDIA_CLEAN_SQL = r"""
SELECT page_id, pos, media_url FROM (
  SELECT page_id, 0::BIGINT AS pos, url AS media_url FROM pages
  UNION ALL SELECT page_id, 1, url || '&a=1&b=2' FROM pages
  UNION ALL SELECT page_id, 2, '' FROM pages)"""

QUERIES = {
    "canonical_url": canonical_url,
    "item_url": item_url,
    "item_key": item_key,
    "url_attributes": url_attributes,
    "expand_pages": expand_pages,
    "set_query_param": set_query_param,
    "resolve_links": resolve_links,
    "scope_filter": scope_filter,
    "media_clean": media_clean,
}
SQL = {
    "canonical_url": CANONICAL_SQL,
    "item_url": ITEM_URL_SQL,
    "item_key": ITEM_KEY_SQL,
    "url_attributes": ATTRIBUTES_SQL,
    "expand_pages": EXPAND_SQL,
    "set_query_param": SET_QUERY_SQL,
    "resolve_links": RESOLVE_SQL,
    "scope_filter": SCOPE_SQL,
    "media_clean": MEDIA_CLEAN_SQL,
}
