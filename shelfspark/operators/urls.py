"""URL tables: canonical forms, keys, attributes, pagination, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import html as H
from shelfspark.functions import urls as U
from shelfspark.functions.core import coalesce_fields, col
from shelfspark.profiles import UrlProfile

DEFAULT = UrlProfile()


def canonicalize_urls(
    df: DataFrame,
    url: str = "url",
    form: str = "section",
    out: str = "canonical_url",
    profile: UrlProfile = DEFAULT,
) -> DataFrame:
    """Canonical URL: ``section`` (root becomes ``/``), ``section_bare`` or ``item``."""
    rules = {
        "section": lambda: U.canonical_section(url, root_slash=True),
        "section_bare": lambda: U.canonical_section(url, root_slash=False),
        "item": lambda: U.canonical_item(url, profile),
    }
    return df.withColumn(out, rules[form]())


def item_key(
    df: DataFrame,
    source: str | Column,
    mode: str = "url",
    out: str = "item_key",
    override: Column | None = None,
    profile: UrlProfile = DEFAULT,
) -> DataFrame:
    """Item key from a URL, a strict value or free text; an override wins in text mode."""
    if mode == "url":
        key = U.key_from_url(source, profile)
    elif mode == "strict":
        key = U.key_strict(source, profile)
    elif mode == "text":
        key = U.key_in_text(source, profile)
        if override is not None:
            key = coalesce_fields(U.key_in_text(override, profile), key)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn(out, key)


def artifact_text(folder: str | Column, stem: str | Column, folder_first: bool = True) -> Column:
    """The text an artifact's key is read from; its two parts may come in either order."""
    parts = [col(folder), col(stem)] if folder_first else [col(stem), col(folder)]
    return F.concat_ws(" ", *parts)


def url_attributes(df: DataFrame, url: str = "url", profile: UrlProfile = DEFAULT) -> DataFrame:
    return df.select(
        "*",
        U.page_number(url, profile).alias("page_no"),
        U.section_or_default(url, profile).alias("section"),
        U.section_raw(url, profile).alias("section_raw"),
        U.cluster_key(url, profile).alias("cluster_key"),
    )


def page_url(url: str | Column, page: Column, profile: UrlProfile = DEFAULT) -> Column:
    """Listing URL of one page number."""
    base = F.regexp_replace(U.canonical_section(url, root_slash=False), "/+$", "")
    base = F.when(
        U.path(base) == "", F.concat(base, F.lit(profile.listing_prefix))
    ).otherwise(base)
    template = F.lit(profile.page_ref + profile.page_query)
    filled = F.replace(template, F.lit("{page}"), page.cast("string"))
    filled = F.replace(filled, F.lit("{section}"), U.section_or_default(url, profile))
    return F.concat(base, filled)


def expand_pages(
    df: DataFrame, n: int, url: str = "url", profile: UrlProfile = DEFAULT
) -> DataFrame:
    """One row per page number 1..n with the listing URL of that page."""
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))
    pages = df.withColumn("page", F.explode(numbers))
    return pages.withColumn("page_url", page_url(url, F.col("page"), profile))


def set_query_param(
    df: DataFrame, url: str, name: str, value: str, out: str = "new_url"
) -> DataFrame:
    """URL with one parameter set; ``rejected`` says why a row has none."""
    new = U.with_query_param(url, name, value)
    reason = "value is blank" if not value.strip() else "scheme is not http(s)"
    return df.withColumn(out, new).withColumn("rejected", F.when(F.col(out).isNull(), reason))


def resolve_links(
    df: DataFrame, base: str, href: str, out: str = "absolute_url"
) -> DataFrame:
    return df.withColumn(out, U.resolve(base, href))


def filter_scope(
    df: DataFrame,
    url: str = "url",
    root: str | None = None,
    follow_others: bool = False,
    profile: UrlProfile = DEFAULT,
) -> DataFrame:
    """URLs of the site's listing tree (and of one section when a root is given)."""
    return df.filter(U.in_scope(url, profile, root, follow_others))


def clean_media_urls(df: DataFrame, urls: str, out: str = "media_urls") -> DataFrame:
    """Plain media URLs of an array column; non-http(s) entries become ''.

    The array crosses to the entity decoder as one string per row, and only when
    it holds an entity beyond the basic five.
    """
    joined = H.unescape(F.array_join(F.coalesce(F.col(urls), F.array()), H.POINT_MARK))
    parts = F.transform(F.split(joined, H.POINT_MARK), H.media_url)
    return df.withColumn(
        out, F.when(F.size(urls) > 0, parts).otherwise(F.array().cast("array<string>"))
    )
