"""The queries of this subpackage over the given tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import (
    decontamination,
    language_id,
    lexical_search,
    minhash,
    packing,
    quality,
    simhash,
    substring_dedup,
    topk_search,
    toxicity,
    url_filters,
    warc_audit,
    whitening,
)
from shelfspark.llm.url_filters import Rule

#: The rules of op5.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

#: What op5 blocks where no rule fits, as globs over host and path, and as patterns for its SQL.
BLOCK_GLOBS = {
    "*casino-*/**": "[^/]*casino-[^/]*/(?s:.*)",
    "*-pills.*/**": r"[^/]*-pills\.[^/]*/(?s:.*)",
    "*spam-*/**": "[^/]*spam-[^/]*/(?s:.*)",
    "**.exe": r"(?s:.*)\.exe",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), k=35, digest=True)


def op2_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records against a replica derived from them: one in 101 altered, one in 211 lost."""
    pages = _table(spark, sf_dir, "pages")
    altered = F.when(F.col("page_id") % 101 == 7, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = pages.where(~F.coalesce(F.col("page_id") % 211 == 3, F.lit(False))).withColumn("html", altered)
    return warc_audit.audit(pages, replica)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of documents are their source; the parts of a site are its languages."""
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host="source", path="lang")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, tuple(BLOCK_GLOBS))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_audit": op2_warc_audit,
    "op3_simhash": op3_simhash,
    "op4_quality": op4_quality,
    "op5_url_filters": op5_url_filters,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_topk_search": op8_topk_search,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_whitening": op12_whitening,
    "op13_minhash": op13_minhash,
}

_RULED = "\n".join(
    f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(URL_RULES, key=lambda r: -len(r.name))
)
_CAUGHT = " OR ".join(f"regexp_full_match(host || path, '{p}')" for p in BLOCK_GLOBS.values())
_BLOCKED = ", ".join(f"'{r.name}'" for r in URL_RULES if r.verdict == "block")

SQL: dict[str, str] = {
    "op2_warc_audit": r"""
WITH bodies AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         CASE WHEN page_id % 101 = 7 THEN '#' || substr(html, 2) ELSE html END AS copy FROM pages WHERE page_id IS NOT NULL
), sized AS (
  SELECT page_id, html, coalesce(copy, '') AS copy,
         strlen('WARC/1.1..WARC-Type: resource..WARC-Record-ID: <urn:page:' || page_id || '>..WARC-Target-URI: ' || coalesce(url, '')
           || '..Content-Type: text/html; charset=utf-8..Content-Length: ....') + 4 AS head FROM bodies
), lengths AS (
  SELECT page_id, html <> copy AS altered, page_id % 211 = 3 AS lost,
         CAST(head + strlen(CAST(strlen(html) AS VARCHAR)) + strlen(html) AS BIGINT) AS length,
         CAST(head + strlen(CAST(strlen(copy) AS VARCHAR)) + strlen(copy) AS BIGINT) AS replica_length FROM sized
), placed AS (
  SELECT *, page_id >> 12 AS archive, CAST(page_id & 4095 AS INTEGER) AS slot,
         CAST(coalesce(sum(length) OVER (PARTITION BY page_id >> 12 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM lengths
)
SELECT archive, slot, page_id, CASE WHEN lost THEN 'missing' ELSE 'changed' END AS kind, CAST(1 AS BIGINT) AS records, "offset", length,
       CASE WHEN NOT lost THEN replica_length END AS replica_length
FROM placed WHERE altered OR lost
""",
    "op8_topk_search": """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
""",
    "op11_lexical_search": r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), tfs AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM sizes) GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total
), scored AS (
  SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (row), total
  GROUP BY item_id, doc_id, row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
""",
    "op5_url_filters": f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests
), parts AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM hosts
), ruled AS (
  SELECT page_id, host, path, CASE {_RULED} END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKED}) OR (rule IS NULL AND ({_CAUGHT})) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
}
