"""Stored pages to tables: links, item ids, fields, media, signals, page edges.

All extraction is narrow (no shuffle). Only global dedupe and joined outcomes
shuffle, and they move links and results, never page bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import html as H
from shelfspark.functions import urls as U
from shelfspark.functions.core import collapse_ws, extract_all, first_match
from shelfspark.operators import queues as Q
from shelfspark.operators.urls import page_url
from shelfspark.profiles import LinkProfile, PageProfile, UrlProfile

PAGE = PageProfile()
SITE = UrlProfile()
LINKS = LinkProfile()


def clean_html(df: DataFrame, html: str = "html", out: str = "clean_text") -> DataFrame:
    """Page text without scripts, styles and tags, entities decoded."""
    return df.withColumn(out, H.clean_text(F.col(html)))


# ---- links -----------------------------------------------------------------
def _tags(links: LinkProfile) -> Column:
    """Array of the page's list, list-item and link tags (and the lists that bound items), in page order.

    A link carries its attributes and text up to the closing tag; one that is not
    closed before the next link or list tag is its opening tag alone.
    """
    tags = "|".join(sorted({links.list_tag, links.up_tag, *LISTS}))
    inner = rf"(?:(?!<a\b|</?(?:{tags})\b).)*?"
    pattern = rf"(?is)<(?:a\b[^>]*>(?:{inner}</a\s*>)?|/?(?:{tags})\b[^>]*>)"
    body = F.col("html")
    if links.nav_pattern:
        body = F.coalesce(first_match(body, [links.nav_pattern], 0), body)
    return extract_all(body, pattern, 0)


#: Lists, inside which an item ends where the next one starts.
LISTS = ("ol", "ul")
ITEM = "li"
#: Links gathered in one array before they move to the array of full ones.
_RUN = 64


def _started(held: Column, tag: Column, mark: Column) -> Column:
    """The open elements, innermost first, after a start tag.

    An item ends an item that is open in the same list.
    """
    names = F.transform(held, lambda e: e["tag"])
    at = F.array_position(names, ITEM).cast("int")
    lists = [F.array_position(names, x).cast("int") for x in LISTS]
    inside = (at > 0) & F.forall(F.array(*lists), lambda n: (n == 0) | (n > at))
    left = F.when((tag == ITEM) & inside, _beyond(held, at)).otherwise(held)
    return F.concat(F.array(F.struct(tag.alias("tag"), mark.alias("mark"))), left)


def _ended(held: Column, tag: Column) -> Column:
    """The open elements after an end tag: its element closes, with all that is open inside.

    An item's end does not reach beyond its list; an end without a start counts for nothing.
    """
    names = F.transform(held, lambda e: e["tag"])
    at = F.array_position(names, tag).cast("int")
    lists = [F.array_position(names, x).cast("int") for x in LISTS]
    cut = (tag == ITEM) & F.exists(F.array(*lists), lambda n: (n > 0) & (n < at))
    return F.when((at == 0) | cut, held).otherwise(_beyond(held, at))


def _beyond(held: Column, at: Column) -> Column:
    return F.slice(held, at + 1, F.greatest(F.size(held) - at, F.lit(0)))


def _open_tags(links: LinkProfile) -> Column:
    """Array of (pos, link, list_marks, up_marks): every link with the number of marked
    lists and list items that are open around it.

    One fold over the page's own tags with a stack of open elements, as a parser builds
    them: end tags that a page leaves out are implied. Links gather in runs of ``_RUN``, so
    no long array is copied at each of them.
    """
    link_type = "struct<pos:int,link:string,list_marks:int,up_marks:int>"
    start = F.struct(
        F.array().cast("array<struct<tag:string,mark:boolean>>").alias("held"),
        F.array().cast(f"array<{link_type}>").alias("run"), F.array().cast(f"array<array<{link_type}>>").alias("full"),
    )
    marked = lambda held, tag: F.size(F.filter(held, lambda e: (e["tag"] == tag) & e["mark"]))

    def step(acc: Column, t: Column) -> Column:
        kind, tag, held = t["kind"], t["tag"], acc["held"]
        link = F.struct(
            t["pos"].alias("pos"), tag.alias("link"),
            marked(held, links.list_tag).alias("list_marks"), marked(held, links.up_tag).alias("up_marks"),
        )
        classes = H.attr(tag, "class")
        mark = ((kind == links.list_tag) & classes.contains(links.list_class)) | ((kind == links.up_tag) & classes.contains(links.up_class))
        is_link, full = kind == "a", F.size(acc["run"]) == _RUN
        run = F.when(is_link & full, F.array(link)).when(is_link, F.concat(acc["run"], F.array(link))).otherwise(acc["run"])
        return F.struct(
            F.when(is_link, held).when(kind.startswith("/"), _ended(held, kind.substr(F.lit(2), F.length(kind)))).otherwise(_started(held, kind, mark)).alias("held"),
            run.alias("run"),
            F.when(is_link & full, F.concat(acc["full"], F.array(acc["run"]))).otherwise(acc["full"]).alias("full"),
        )

    kind = lambda t: F.lower(F.regexp_extract(t, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1))
    tags = F.transform(_tags(links), lambda t, i: F.struct(i.alias("pos"), kind(t).alias("kind"), t.alias("tag")))
    return F.aggregate(tags, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["run"]))))


def page_links(
    pages: DataFrame,
    links: LinkProfile = LINKS,
    site: UrlProfile = SITE,
    root: str | None = None,
    follow_others: bool = True,
    in_scope_only: bool = True,
) -> DataFrame:
    """Every link of every page with its list depth and up-link flag: a narrow stage."""
    found = pages.select("page_id", "url", F.inline(_open_tags(links)))
    href = H.attr("link", "href")
    text = collapse_ws(H.unescape(H.strip_markup(F.col("link"))))
    out = (
        found.withColumn("href", href)
        .filter((F.col("href") != "") & F.col("href").contains(links.href_contains))
        .withColumn("_target", H.unescape(F.col("href")))
        .select(
            "page_id",
            F.col("url").alias("source_url"),
            "pos",
            "href",
            "_target",
            text.alias("branch_name"),
            F.greatest(F.col("list_marks") - 1, F.lit(0)).cast("bigint").alias("depth"),
            (F.col("up_marks") > 0).alias("is_up_link"),
        )
        .withColumn(
            "branch_url",
            U.canonical_section(U.resolve("source_url", "_target")),
        )
        .drop("_target")
        .withColumn("source_page", U.canonical_section("source_url"))
        .withColumn("cluster_key", U.cluster_key("branch_url", site))
    )
    if in_scope_only:
        out = out.filter(U.in_scope("branch_url", site, root, follow_others))
    return out


def extract_links(
    pages: DataFrame,
    links: LinkProfile = LINKS,
    site: UrlProfile = SITE,
    root: str | None = None,
    follow_others: bool = True,
    in_scope_only: bool = True,
) -> DataFrame:
    """First sighting of every link target over all pages, in page order."""
    found = page_links(pages, links, site, root, follow_others, in_scope_only)
    return Q.top_n_per_key(found, ["branch_url"], ["page_id", "pos"], 1, "_rn").drop("_rn")


def seed_branch(pages: DataFrame, name: str, url: str, site: UrlProfile = SITE) -> DataFrame:
    """The start row of a link table: depth 0, seen on the first page."""
    seed = F.lit(url)
    return pages.agg(F.min_by("url", "page_id").alias("_first")).select(
        F.lit(name).alias("branch_name"),
        seed.alias("branch_url"),
        U.canonical_section("_first").alias("source_page"),
        F.lit(0).cast("bigint").alias("depth"),
        F.lit(False).alias("is_up_link"),
        U.cluster_key(U.canonical_section(seed), site).alias("cluster_key"),
        F.lit(True).alias("is_seed"),
    )


# ---- items -----------------------------------------------------------------
def item_urls_of_page(page: PageProfile = PAGE, site: UrlProfile = SITE) -> Column:
    """Array of item URLs: card links in page order, then the other ids sorted."""
    html = F.col("html")
    cards = F.filter(
        extract_all(html, page.card_link_pattern, 0),
        lambda t: (H.attr(t, "href") != "") & H.attr(t, "class").contains(page.card_link_class),
    )
    linked = F.filter(
        F.transform(
            H.unescape_all(F.transform(cards, lambda t: H.attr(t, "href"))),
            lambda h: U.canonical_item(U.resolve("url", h), site),
        ),
        lambda u: u.startswith(site.item_prefix) | u.contains("/dp/"),
    )
    tagged = extract_all(html, page.item_attr_pattern)
    lists = F.filter(
        F.concat(
            extract_all(html, page.item_json_pattern, 1),
            extract_all(html, page.item_json_pattern, 2),
        ),
        lambda v: v != "",
    )

    def ids_of(value: Column) -> Column:
        parsed = F.when(
            value.startswith("["), F.from_json(value, "array<struct<id:string>>")
        )
        return F.coalesce(
            F.transform(parsed, lambda o: F.coalesce(o["id"], F.lit(""))),
            extract_all(value, page.item_json_id),
        )

    listed = F.flatten(F.transform(H.unescape_all(F.transform(lists, F.trim)), ids_of))
    ids = F.filter(
        F.transform(F.concat(tagged, listed), lambda v: U.key_strict(v, site)),
        lambda v: v != "",
    )
    rest = F.transform(
        F.array_sort(F.array_distinct(ids)), lambda v: F.concat(F.lit(site.item_prefix), v)
    )
    return F.array_union(F.array_distinct(linked), rest)


def extract_item_ids(
    pages: DataFrame, page: PageProfile = PAGE, site: UrlProfile = SITE
) -> DataFrame:
    """One row per page and item URL, in the page's order."""
    return pages.select(
        "page_id", F.posexplode(item_urls_of_page(page, site)).alias("pos", "item_url")
    ).withColumn("pos", F.col("pos").cast("bigint"))


# ---- fields, media, signals --------------------------------------------------
_FIELD_MARK = "\x02"


def extract_fields(
    pages: DataFrame, page: PageProfile = PAGE, html: Column | None = None
) -> DataFrame:
    """Adds title, points (array) and description."""
    body = F.col("html") if html is None else html
    title, strong = H.raw_title(body, page)
    packed = F.concat_ws(
        _FIELD_MARK, H.strip_markup(title), H.raw_points(body, page), H.raw_meta(body, page)
    )
    staged = pages.withColumn("_packed", packed).withColumn("_strong", strong)
    staged = staged.withColumn("_parts", F.split(H.unescape(F.col("_packed")), _FIELD_MARK))
    part = lambda i: F.coalesce(F.try_element_at("_parts", F.lit(i)), F.lit(""))
    return (
        staged.withColumn("title", H.drop_title_suffix(H.tidy(part(1)), F.col("_strong"), page))
        .withColumn("points", H.points_array(part(2), part(3), page))
        .withColumn("description", F.array_join("points", " | "))
        .drop("_packed", "_strong", "_parts")
    )


def _decoded_for_media(html: Column) -> Column:
    """Entity-decoded page; pages without an ampersand are so already."""
    return F.coalesce(H.unescape(F.when(html.contains("&"), html)), html)


def extract_media(
    pages: DataFrame, page: PageProfile = PAGE, html: Column | None = None
) -> DataFrame:
    """Adds media_urls: unique plain URLs in page order."""
    body = F.col("html") if html is None else html
    staged = pages.withColumn("_decoded", _decoded_for_media(body))
    return staged.withColumn(
        "media_urls",
        F.coalesce(
            H.media_urls(body, F.col("_decoded"), page), F.array().cast("array<string>")
        ),
    ).drop("_decoded")


def detect_presence(
    pages: DataFrame, page: PageProfile = PAGE, html: Column | None = None
) -> DataFrame:
    """Adds has_video, video_count, signals (needs media_urls).

    The marked block is judged first; media found elsewhere on the page then
    sets the flag, and a flagged page counts at least one.
    """
    body = F.col("html") if html is None else html
    block = F.when(
        F.locate(page.presence_marker, body) > 0,
        H.block_after(body, page.presence_marker, page.presence_block),
    )
    staged = pages.withColumn("_decoded", _decoded_for_media(block))
    in_block = F.coalesce(H.media_urls(block, F.col("_decoded"), page), F.col("media_urls"))
    staged = staged.withColumn("_in_block", in_block)
    staged = staged.withColumn("_p", H.presence(body, page, F.col("_in_block")))
    has = F.col("_p.has") | (F.size("media_urls") > 0)
    n_media = F.size("media_urls").cast("bigint")
    n = F.when(
        has & (F.col("_p.n") == 0), F.greatest(n_media, F.lit(1).cast("bigint"))
    ).otherwise(F.col("_p.n"))
    return (
        staged.withColumn("has_video", F.coalesce(has, F.lit(False)))
        .withColumn("video_count", F.coalesce(n, F.lit(0).cast("bigint")))
        .withColumn(
            "signals", F.coalesce(F.col("_p.signals"), F.array().cast("array<string>"))
        )
        .drop("_decoded", "_in_block", "_p")
    )


def classify_blocked(
    pages: DataFrame, page: PageProfile = PAGE, fetch_error: Column | None = None
) -> DataFrame:
    """Adds blocked and error; a page that could not be fetched keeps the text of that error."""
    failed = F.coalesce(F.trim(fetch_error), F.lit("")) if fetch_error is not None else F.lit("")
    flag = F.coalesce(H.blocked(F.col("html"), page), F.lit(False)) & (failed == "")
    return pages.withColumn("blocked", flag).withColumn(
        "error", F.when(flag, F.lit(page.blocked_error)).otherwise(failed)
    )


def page_results(
    pages: DataFrame,
    page: PageProfile = PAGE,
    site: UrlProfile = SITE,
    max_media: int = 0,
    fetch_error: Column | None = None,
    downloads: DataFrame | None = None,
) -> DataFrame:
    """One result row per page: blocked test, fields, media, signals.

    A page that was blocked, or not fetched (``fetch_error`` has a text), keeps the
    defaults of all other fields, so its body is nulled before any extraction runs.
    ``planned_files`` has target names for the first ``max_media`` media URLs (0: all).
    ``downloads`` (url, video_url, path, error) tells what became of them: without it
    nothing was downloaded. Only this join shuffles, and it moves results, not bodies.
    """
    body = F.when(F.col("error") == "", F.col("html"))
    out = classify_blocked(pages, page, fetch_error)
    out = extract_fields(out, page, body)
    out = extract_media(out, page, body)
    out = detect_presence(out, page, body)
    key = U.key_from_url("url", site)
    owner = F.when(key != "", key).otherwise(F.lit("unknown"))
    chosen = F.slice("media_urls", 1, max_media) if max_media > 0 else F.col("media_urls")
    names = F.transform(
        chosen,
        lambda _, i: F.concat(
            owner, F.lit("_video_"), F.lpad((i + 1).cast("string"), 2, "0"), F.lit(".mp4")
        ),
    )
    none = F.array().cast("array<string>")
    out = out.select(
        *[c for c in pages.columns if c not in ("html", "error")],
        key.alias("item_key"),
        "title",
        "description",
        "has_video",
        "video_count",
        F.col("media_urls").alias("video_urls"),
        F.when(F.col("has_video"), names).otherwise(none).alias("planned_files"),
        "blocked",
        "error",
        "signals",
    )
    return _with_downloads(out, downloads)


_OUTCOME = "array<struct<video_url:string,error:string>>"


def _with_downloads(results: DataFrame, downloads: DataFrame | None) -> DataFrame:
    """Adds downloaded_videos and download_errors, in the order of the page's media."""
    if downloads is None:
        return results.withColumns({
            "downloaded_videos": F.array().cast("array<string>"),
            "download_errors": F.array().cast(_OUTCOME),
        })
    failed = F.coalesce(F.trim("error"), F.lit("")) != ""
    tried = downloads.select(
        "url", F.struct("video_url", F.when(~failed, F.col("path")).alias("path"), F.when(failed, F.trim("error")).alias("error")).alias("_try")
    ).groupBy("url").agg(F.collect_list("_try").alias("_tries"))
    placed = F.array_sort(F.transform(
        F.coalesce("_tries", F.array().cast("array<struct<video_url:string,path:string,error:string>>")),
        lambda t: F.struct(F.array_position("video_urls", t["video_url"]).alias("at"), t["video_url"].alias("video_url"),
                           t["path"].alias("path"), t["error"].alias("error")),
    ))
    out = results.join(tried, "url", "left").withColumn("_tries", placed)
    return out.withColumns({
        "downloaded_videos": F.transform(F.filter("_tries", lambda t: t["path"].isNotNull()), lambda t: t["path"]),
        "download_errors": F.transform(
            F.filter("_tries", lambda t: t["error"].isNotNull()),
            lambda t: F.struct(t["video_url"].alias("video_url"), t["error"].alias("error")),
        ),
    }).drop("_tries")


# ---- pagination --------------------------------------------------------------
def next_page_edges(
    pages: DataFrame,
    page: PageProfile = PAGE,
    site: UrlProfile = SITE,
    max_pages: int = 0,
    scheduled: DataFrame | None = None,
) -> DataFrame:
    """Listing pages to visit next: (branch_url, page_no, page_url, via).

    An explicit next link wins; else higher page numbers of the pagination
    block; else page + 1 when items were seen and no pagination block exists.
    ``scheduled`` (branch_url, page_no) holds pages already planned.
    """
    html = F.col("html")
    combined = "|".join(f"(?:{p})" for p in page.next_link_patterns)
    next_href = F.coalesce(
        *[
            F.nullif(F.regexp_extract(html, combined, i + 1), F.lit(""))
            for i in range(len(page.next_link_patterns))
        ],
        F.lit(None).cast("string"),
    )
    block = first_match(html, [page.pagination_pattern])
    edge = lambda url, via: F.struct(
        U.page_number(url, site).alias("page_no"), url.alias("page_url"), F.lit(via).alias("via")
    )
    staged = pages.select(
        "page_id",
        "url",
        U.canonical_section("url", root_slash=False).alias("branch_url"),
        U.page_number("url", site).alias("current_page"),
        H.unescape(next_href).alias("_next"),
        block.alias("_block"),
        (F.size(item_urls_of_page(page, site)) > 0).alias("_items"),
    )
    numbered = F.transform(
        H.unescape_all(extract_all(F.col("_block"), page.page_link_pattern)),
        lambda h: edge(U.resolve("url", h), "number"),
    )
    onward = F.struct(
        (F.col("current_page") + 1).alias("page_no"),
        page_url("branch_url", F.col("current_page") + 1, site).alias("page_url"),
        F.lit("onward").alias("via"),
    )
    candidates = (
        F.when(
            F.col("_next").isNotNull(),
            F.array(edge(U.resolve("url", "_next"), "next")),
        )
        .when(
            F.col("_block").isNotNull(),
            F.filter(numbered, lambda e: e["page_no"] > F.col("current_page")),
        )
        .when(F.col("_items"), F.array(onward))
    )
    edges = staged.select("page_id", "branch_url", "current_page", F.inline(candidates))
    if max_pages > 0:
        edges = edges.filter(
            (F.col("current_page") < max_pages) & (F.col("page_no") <= max_pages)
        )
    if scheduled is not None:
        edges = edges.join(scheduled, ["branch_url", "page_no"], "left_anti")
    order = ["current_page", "page_id", "page_url"]
    return Q.top_n_per_key(edges, ["branch_url", "page_no"], order, 1, "_rn").drop("_rn")
