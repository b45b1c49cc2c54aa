"""Whole jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.plans import flows
from shelfspark.registry import pages as RP
from shelfspark.registry.base import canonical, table


def link_table(spark, sf):
    out = flows.link_table(
        table(spark, sf, "pages"), "Start", "https://shop.example/", RP.LINKS, RP.ANY_SITE,
        in_scope_only=False,
    )
    return out.select(
        "branch_name", "branch_url", "source_page", "depth", "is_up_link", "cluster_key", "is_seed"
    )


LINK_TABLE_SQL = RP.LINK_TOKENS_SQL + f"""
SELECT branch_name, branch_url, source_page, depth, is_up_link, cluster_key, NULL::BOOLEAN AS is_seed
FROM firsts
UNION ALL
SELECT 'Start', 'https://shop.example/', (SELECT min_by({canonical('url')}, page_id) FROM pages), 0, false,
  'root', true"""


def publish_plan(spark, sf):
    """Orders as items of customers: returned lines are published, big open lines
    were skipped, late shipments have their artifact ready."""
    lines = table(spark, sf, "lineitem")
    key = F.col("l_orderkey").alias("url")
    items = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("branch"), F.col("o_orderkey").alias("url"), F.col("o_orderkey").alias("pos")
    )
    state = lines.filter("l_returnflag = 'R' AND l_quantity > 25").select(key)
    log = lines.filter("l_returnflag = 'R' AND l_discount > 0.05").select(key)
    skipped = lines.filter("l_linestatus = 'O' AND l_quantity > 40").select(
        key, F.col("l_orderkey").cast("string").alias("item_key")
    ).distinct()
    ready = lines.filter("l_shipdate > '1998-06-01'").select(
        F.col("l_orderkey").cast("string").alias("item_key")
    )
    out = flows.publish_plan(items, state, log, skipped, ready, "2024-01-01 12:00:00")
    return out["plan"].select("branch", "url", "slot_no", "slot_at")


PUBLISH_SQL = """
WITH up AS (
  SELECT DISTINCT l_orderkey AS k FROM lineitem
  WHERE l_returnflag = 'R' AND (l_quantity > 25 OR l_discount > 0.05::DOUBLE)),
sk AS (
  SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 40
    AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-06-01')),
q AS (
  SELECT o_custkey AS branch, o_orderkey AS url, row_number() OVER (ORDER BY o_orderkey) AS slot_no FROM orders
  WHERE o_orderkey NOT IN (SELECT k FROM up) AND o_orderkey NOT IN (SELECT k FROM sk)),
c AS (
  SELECT slot_at, row_number() OVER (ORDER BY slot_at) AS n FROM (
    SELECT (TIMESTAMP '2024-01-01' + d * INTERVAL 1 DAY + m * INTERVAL 1 MINUTE)::TIMESTAMP AS slot_at
    FROM (SELECT unnest(range((SELECT count(*) // 3 + 3 FROM q))) AS d), (SELECT unnest([690, 1050, 1170]) AS m))
  WHERE slot_at > TIMESTAMP '2024-01-01 12:00:00')
SELECT branch, url, slot_no, slot_at FROM q JOIN c ON q.slot_no = c.n"""


def script_segments(spark, sf):
    """Documents as scripts, by the full repetition rule."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return flows.script_segments(
        docs, "doc_id", "text", F.greatest(F.lit(6.0), F.col("n_chars") / 15), 6,
        opening="Stop and look", closing="Buy it now",
    )


QUERIES = {f.__name__: f for f in (link_table, publish_plan, script_segments)}
SQL = {"link_table": LINK_TABLE_SQL, "publish_plan": PUBLISH_SQL}
