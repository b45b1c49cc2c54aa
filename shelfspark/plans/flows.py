"""Whole jobs put together from the operators: links, pages, queue, script copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.functions.core import coalesce_fields
from shelfspark.functions.urls import canonical_section
from shelfspark.operators import aggregates as A
from shelfspark.operators import pages as P
from shelfspark.operators import queues as Q
from shelfspark.operators import sequence as S
from shelfspark.operators import text as O
from shelfspark.profiles import DAILY_SLOTS, LinkProfile, PageProfile, UrlProfile
from shelfspark.session import checkpoint_root


def link_table(
    pages: DataFrame,
    name: str,
    start_url: str,
    links: LinkProfile = P.LINKS,
    site: UrlProfile = P.SITE,
    root: str | None = None,
    follow_others: bool = False,
    in_scope_only: bool = True,
) -> DataFrame:
    """Seed row plus every link target, first sighting each, the seed before all."""
    seed = P.seed_branch(pages, name, start_url, site).withColumns(
        {"page_id": F.lit(-1).cast("bigint"), "pos": F.lit(0)}
    )
    found = P.page_links(pages, links, site, root, follow_others, in_scope_only)
    found = found.withColumn("is_seed", F.lit(None).cast("boolean"))
    # The seed is known by its canonical URL, and kept with the URL it was given.
    every = found.withColumn("_key", F.col("branch_url")).select(*seed.columns, "_key").unionByName(
        seed.withColumn("_key", canonical_section("branch_url"))
    )
    return Q.top_n_per_key(every, ["_key"], ["page_id", "pos"], 1, "_rn").drop("_rn", "_key")


def inspect_pages(
    pages: DataFrame,
    order: DataFrame,
    page: PageProfile = P.PAGE,
    site: UrlProfile = P.SITE,
    max_media: int = 0,
    fetch_error: Column | None = None,
    downloads: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results in input order, one summary row)."""
    results = P.page_results(pages, page, site, max_media, fetch_error, downloads)
    return Q.restore_order(results, order), A.summarize(results)


def publish_plan(
    items: DataFrame,
    state: DataFrame,
    log: DataFrame,
    skipped: DataFrame,
    artifacts: DataFrame,
    start: str,
    slots: Sequence[str] = DAILY_SLOTS,
    branch: str = "branch",
    key: str = "url",
    position: str = "pos",
) -> dict[str, DataFrame]:
    """Log into state, recover skipped items, queue what is left, give it slots.

    ``items`` (branch, key, position), ``skipped`` (key, item_key), ``artifacts``
    (item_key). Positions order the whole queue.
    """
    uploaded = Q.merge_log(state, log, key).select(key)
    _, remaining, _ = Q.recover_skipped(
        skipped, artifacts, items.select(key, F.col(position).alias("pos")), key=key
    )
    # The queue is the same with keys of state and log that are repeated. It is written once:
    # chunks are counted, sampled and ranked from it.
    checkpoint_root(items.sparkSession)
    done = state.select(key).unionByName(log.select(key).filter(F.length(F.col(key).cast("string")) > 0))
    queue = Q.pending(items, done, remaining, key, [branch], [position]).checkpoint()
    closed = uploaded.withColumn("state", F.lit("done")).unionByName(
        remaining.select(key).withColumn("state", F.lit("skipped"))
    )
    return {
        "uploaded": uploaded,
        "skipped": remaining,
        "progress": Q.branch_progress(items, closed, branch, key, position),
        "plan": Q.assign_slots(queue, position, start, slots),
    }


def choose_opening(override: Column, model: Column, generated: Column, script: Column) -> Column:
    """Opening line: override, model's, generated, else the first sentence."""
    first = F.coalesce(F.try_element_at(X.sentences(script), F.lit(1)), F.lit(""))
    return coalesce_fields(override, model, generated, first)


def script_segments(
    scripts: DataFrame,
    key: str,
    text: str,
    total: Column,
    scenes: int,
    min_seconds: float = 1.2,
    opening: str = "",
    closing: str = "",
    similar: bool = True,
) -> DataFrame:
    """Clean script text cut into timed scenes.

    Repeats go, opening and closing lines are put in, repeats go again, the
    sentences get times by weight and are merged down to ``scenes``. A script's lines stay
    in its row, so nothing is shuffled; each row is a script of its own, also where its key
    is null or repeated.
    """
    checkpoint_root(scripts.sparkSession)
    df = scripts.select(key, total.cast("double").alias("_total"), F.col(text).alias("_t0"))
    # Each step is written once: the next ones read it more than once, and the
    # repetition rule must not run again for each of them.
    df = O.drop_repeats(df, "_t0", 12, similar, out="_t1").select(key, "_total", "_t1").checkpoint()
    df = O.ensure_lines(df, "_t1", opening, closing, out="_t2", similar=similar)
    df = df.select(key, "_total", "_t2").checkpoint()
    df = O.drop_repeats(df, "_t2", 14, similar, out="_t3").select(key, "_total", X.sentences(F.col("_t3")).alias("_lines"))
    return S.scenes_of_lines(df, key, "_lines", F.col("_total"), scenes, min_seconds)
