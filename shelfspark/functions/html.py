"""Column rules for stored page bodies: clean text, fields, media, signals."""

from __future__ import annotations

import html as _html

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.core import (
    WS, any_of, col, contains_any, extract_all, first_match, let,
)
from shelfspark.profiles import PageProfile

# Separates parts of a page while they share one string; never part of a page.
POINT_MARK = "\x01"

# Entities decoded without leaving the JVM; the ampersand comes last.
BASIC_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)
_ONLY_BASIC = r"&(?:amp|lt|gt|quot|#39);"


#: A reference as Python's html.unescape finds it.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _entity_decoder():
    # A local function travels by value, so executors need no copy of this package.
    def decode(found: pa.Array) -> pa.Array:
        known = found.flatten().dictionary_encode()
        plain = pa.array([_html.unescape(t) for t in known.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(found), 0)
        at = pa.array([0, *pc.cumulative_sum(sizes).to_pylist()], pa.int32())
        return pa.ListArray.from_arrays(at, plain.take(known.indices), mask=pc.is_null(found))

    return F.arrow_udf(decode, T.ArrayType(T.StringType()))


_decode_entities = _entity_decoder()


def unescape(text: Column, full: bool = True) -> Column:
    """HTML entity decoding.

    The basic five are replaced natively. Of text that holds any other entity, or
    one that only appears after replacement order matters, the references alone are sent
    through one Arrow batch function and put back between the pieces of the text, so that bodies
    do not cross; all other rows send null.
    """
    native = text
    for entity, char in BASIC_ENTITIES:
        native = F.replace(native, F.lit(entity), F.lit(char))
    if not full:
        return native
    rest = F.regexp_replace(text, _ONLY_BASIC, " ")
    # "&amp;lt;" must stay one step decoded: leave such chains to the exact decoder.
    hard = rest.rlike("&[#A-Za-z]") | text.rlike("(?i)&amp;#?[a-z0-9]+;?")
    decoded = _decode_entities(F.when(hard, F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))))
    # One piece more than references.
    put_back = F.array_join(F.zip_with(
        F.split(text, _REFERENCE, -1), decoded, lambda piece, char: F.concat(piece, F.coalesce(char, F.lit("")))
    ), "")
    return F.when(decoded.isNotNull(), put_back).otherwise(native)


def unescape_all(texts: Column) -> Column:
    """Entity decoding of an array of strings without control marks: one call per row."""
    joined = unescape(F.array_join(texts, POINT_MARK))
    none = F.array().cast("array<string>")
    return F.when(F.size(texts) > 0, F.split(joined, POINT_MARK)).when(texts.isNotNull(), none)


def strip_markup(fragment: Column) -> Column:
    """Script and style bodies and tags become blanks; entities are kept."""
    out = fragment
    for pattern in (
        r"(?is)<script\b[^>]*>.*?</script>",
        r"(?is)<style\b[^>]*>.*?</style>",
        "<[^>]+>",
    ):
        out = F.regexp_replace(out, pattern, " ")
    return out


def tidy(text: Column) -> Column:
    """Direction marks become blanks, white space collapses."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{200e}\x{200f}]+", " "))


def clean_text(fragment: Column, full: bool = True) -> Column:
    return tidy(unescape(strip_markup(F.coalesce(fragment, F.lit(""))), full))


def block_after(html: Column, marker: str, size: int) -> Column:
    """The page from the marker on (``size`` characters of it, if not 0), the whole page without it."""
    at = F.locate(marker, html)
    return F.when(at > 0, _from(html, at, size)).otherwise(html)


def _from(text: Column, at: Column, size: int) -> Column:
    return F.substring(text, at, F.lit(size) if size else F.length(text))


def blocked(html: Column, profile: PageProfile) -> Column:
    return contains_any(F.lower(html), profile.blocked_phrases)


def raw_title(html: Column, profile: PageProfile) -> tuple[Column, Column]:
    """(markup of the title, does it come from the first pattern?)"""
    strong = profile.title_patterns[0]
    return F.coalesce(first_match(html, profile.title_patterns), F.lit("")), html.rlike(strong)


def drop_title_suffix(title: Column, from_first: Column, profile: PageProfile) -> Column:
    return F.when(from_first, title).otherwise(
        F.regexp_replace(title, profile.title_suffix, "")
    )


def raw_points(html: Column, profile: PageProfile) -> Column:
    """Markup of all list points joined by a mark, else '' (one string, so that
    entity decoding needs one call per page)."""
    lowered = F.lower(html)
    at = F.lit(0)
    for marker in reversed(profile.points_markers):
        hit = F.locate(marker.lower(), lowered)
        at = F.when(hit > 0, hit).otherwise(at)
    block = _from(html, at, profile.points_block)
    return F.when(
        at > 0,
        F.array_join(
            F.transform(extract_all(block, profile.point_pattern), strip_markup), POINT_MARK
        ),
    ).otherwise(F.lit(""))


def raw_meta(html: Column, profile: PageProfile) -> Column:
    return strip_markup(F.coalesce(first_match(html, [profile.meta_pattern]), F.lit("")))


def points_array(decoded: Column, decoded_meta: Column, profile: PageProfile) -> Column:
    """Unique non-blank points without the boilerplate one; meta text as fallback."""
    skip = profile.point_skip_prefix.lower()
    listed = F.filter(
        F.transform(F.split(decoded, POINT_MARK), tidy),
        lambda p: (p != "") & ~F.lower(p).startswith(skip),
    )
    meta = F.filter(F.array(tidy(decoded_meta)), lambda p: p != "")
    return F.array_distinct(let(listed, lambda a: F.when(F.size(a) > 0, a).otherwise(meta)))


# ---- fixed values: escapes undone in media URLs --------------------------
MEDIA_ESCAPES = (
    ("\\/", "/"),
    ("\\u002F", "/"),
    ("\\u0026", "&"),
    ("\\u003D", "="),
    ("\\u003d", "="),
    ("\\u003F", "?"),
    ("\\u003f", "?"),
)


def media_url(decoded: Column) -> Column:
    """One entity-decoded media reference in plain form, '' unless it is http(s)."""
    url = F.regexp_replace(decoded, rf"^{WS}+|(?U)\s+$", "")
    url = F.btrim(url, F.lit("\"'"))
    for escape, char in MEDIA_ESCAPES:
        url = F.replace(url, F.lit(escape), F.lit(char))
    url = F.rtrim(url, F.lit("\\"))
    url = F.regexp_replace(url, r"[)\],]+$", "")
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.lit(""))


def media_candidates(source: Column, profile: PageProfile) -> Column:
    return F.concat(
        extract_all(source, profile.media_json_pattern),
        extract_all(source, profile.media_url_pattern, 0),
    )


def media_urls(html: Column, decoded: Column, profile: PageProfile) -> Column:
    """Unique media URLs in order: decoded page first, then the raw one.

    ``decoded`` is the entity-decoded page. Every candidate is decoded in full too; all
    of a page travel as one string.
    """
    found = F.concat(
        media_candidates(decoded, profile), media_candidates(html, profile)
    )
    plain = F.transform(unescape_all(found), media_url)
    return F.array_distinct(
        F.filter(
            plain,
            lambda u: (u != "")
            & any_of([F.lower(u).contains(s) for s in profile.media_suffixes]),
        )
    )


def presence(html: Column, profile: PageProfile, media_in_block: Column) -> Column:
    """struct(has, n, signals) of the marked block, before the page-level rules."""

    def judge(block: Column) -> Column:
        thumb = block.rlike(profile.thumb_pattern)
        action = block.rlike(profile.action_pattern)
        labelled = block.rlike(profile.count_pattern)
        label = F.regexp_extract(block, profile.count_pattern, 1).try_cast("bigint")
        hits = F.regexp_count(block, F.lit(profile.thumb_pattern)).cast("bigint")
        n_media = F.size(media_in_block).cast("bigint")
        base = (
            F.when(labelled, label)
            .when(thumb | action, F.greatest(F.lit(1).cast("bigint"), hits))
            .otherwise(F.lit(0).cast("bigint"))
        )
        n = F.when((n_media > 0) & (base == 0), n_media).otherwise(base)
        flags = (thumb, action, labelled, n_media > 0)
        signals = F.array_compact(
            F.array(*[F.when(f, F.lit(s)) for f, s in zip(flags, profile.signals)])
        )
        return F.struct(
            (thumb | action | (n > 0) | (n_media > 0)).alias("has"),
            n.alias("n"),
            signals.alias("signals"),
        )

    return let(block_after(html, profile.presence_marker, profile.presence_block), judge)


def attr(tag: Column | str, name: str) -> Column:
    """Attribute value of one opening tag, '' when absent."""
    tag = col(tag)
    quoted = rf"""(?is)\s{name}\s*=\s*"([^"]*)\""""
    single = rf"(?is)\s{name}\s*=\s*'([^']*)'"
    bare = rf"""(?is)\s{name}\s*=\s*([^\s"'>]+)"""
    return F.coalesce(first_match(tag, [quoted, single, bare]), F.lit(""))
