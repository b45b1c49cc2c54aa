"""Column rules for URLs: splitting, canonical forms, attributes, resolution.

A URL is split once, by one regular expression, into an array of five parts;
``let`` binds that array so that no rule repeats the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.core import col, first_match, let
from shelfspark.profiles import UrlProfile

# scheme, authority, path, query, fragment
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SEP = "\x01"
SCHEME, NETLOC, PATH, QUERY, FRAGMENT = range(5)

Url = Column | str


def parts(url: Url) -> Column:
    """[scheme, authority, path, query, fragment], '' for what is absent."""
    clean = F.regexp_replace(
        F.coalesce(col(url), F.lit("")), r"^[\x00-\x20]+|[\t\r\n\x01]", ""
    )
    return F.split(F.regexp_replace(clean, SPLIT, _SEP.join(f"${i}" for i in range(1, 6))), _SEP)


def with_parts(url: Url, body: Callable[[Column], Column]) -> Column:
    return let(parts(url), body)


def scheme(url: Url) -> Column:
    return F.lower(parts(url)[SCHEME])


def host(url: Url) -> Column:
    return F.lower(parts(url)[NETLOC])


def query(url: Url) -> Column:
    return parts(url)[QUERY]


def _no_params(p: Column) -> Column:
    return F.regexp_replace(p, ";[^/]*$", "")


def path(url: Url) -> Column:
    """Path without the ``;params`` of its last segment."""
    return _no_params(parts(url)[PATH])


def _https(netloc: Column, p: Column) -> Column:
    return F.concat(
        F.lit("https://"), netloc, F.when((p == "") | p.startswith("/"), p).otherwise(
            F.concat(F.lit("/"), p)
        ),
    )


def _section_path(p: Column, root_slash: bool) -> Column:
    """Path cut before ``/ref=`` and without trailing slashes, unless it is ``/``."""
    cut = F.regexp_replace(_no_params(p), "(?s)/ref=.*$", "")
    # "/" alone stays; otherwise trailing slashes go.
    out = F.regexp_replace(cut, "(?<=.)/+$|^//+$", "")
    return F.when(out == "", F.lit("/")).otherwise(out) if root_slash else out


def canonical_section(url: Url, root_slash: bool = True) -> Column:
    """https, lower-case host, trimmed path; no params, query or fragment."""
    return with_parts(
        url,
        lambda a: let(
            _section_path(a[PATH], root_slash), lambda p: _https(F.lower(a[NETLOC]), p)
        ),
    )


def _item_id(p: Column, profile: UrlProfile) -> Column:
    return F.upper(first_match(p, ["(?i)" + q for q in profile.item_patterns]))


def item_id(url: Url, profile: UrlProfile) -> Column:
    """Upper-case item id of the path, null when the path carries none."""
    return let(path(url), lambda p: _item_id(p, profile))


def canonical_item(url: Url, profile: UrlProfile) -> Column:
    """Fixed prefix plus item id; other URLs only lose query and fragment."""
    return with_parts(
        url,
        lambda a: F.coalesce(
            F.concat(F.lit(profile.item_prefix), _item_id(_no_params(a[PATH]), profile)),
            _https(F.lower(a[NETLOC]), a[PATH]),
        ),
    )


def key_from_url(url: Url, profile: UrlProfile) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(col(url), F.lit("")), profile.key_pattern, 1))


def key_strict(value: Url, profile: UrlProfile) -> Column:
    return let(
        F.upper(F.trim(F.coalesce(col(value), F.lit("")))),
        lambda v: F.when(v.rlike(f"^(?:{profile.item_id})$"), v).otherwise(F.lit("")),
    )


def key_in_text(text: Url, profile: UrlProfile) -> Column:
    """First stand-alone id-shaped word of the upper-cased text."""
    word = r"[\p{L}\p{N}_]"
    return F.regexp_extract(
        F.upper(F.coalesce(col(text), F.lit(""))),
        f"(?<!{word})({profile.item_id})(?!{word})",
        1,
    )


def segments(url: Url) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def page_number(url: Url, profile: UrlProfile) -> Column:
    def pick(a: Column) -> Column:
        in_query = F.regexp_extract(a[QUERY], f"(?:^|&){profile.page_param}=([^&]+)", 1)
        in_path = F.regexp_extract(_no_params(a[PATH]), profile.page_path_pattern, 1)
        return F.coalesce(
            F.trim(in_query).try_cast("bigint"),
            in_path.try_cast("bigint"),
            F.lit(1).cast("bigint"),
        )

    return with_parts(url, pick)


def section_or_default(url: Url, profile: UrlProfile) -> Column:
    """Lower-case segment after the listing marker, else the default section."""
    found = F.regexp_extract(path(url), f"(?i){profile.listing_prefix}/([^/?#]+)", 1)
    return F.lower(F.coalesce(F.nullif(found, F.lit("")), F.lit(profile.default_section)))


def section_raw(url: Url, profile: UrlProfile) -> Column:
    """Segment after the marker segment, as written, null when absent."""
    marker = profile.prefix_parts[-1] if profile.prefix_parts else None

    def pick(segs: Column) -> Column:
        if marker is None:
            return F.try_element_at(segs, F.lit(1))
        at = F.array_position(segs, marker).cast("int")
        return F.when(at > 0, F.try_element_at(segs, at + 1))

    return let(segments(url), pick)


def cluster_key(url: Url, profile: UrlProfile) -> Column:
    """Numeric leaf under the listing prefix, else its section, else ``root``."""
    prefix = profile.prefix_parts
    k = len(prefix)

    def pick(segs: Column) -> Column:
        inside = F.lit(True)
        for i, name in enumerate(prefix):
            inside = inside & (F.try_element_at(segs, F.lit(i + 1)) == name)
        section = F.try_element_at(segs, F.lit(k + 1))
        leaf = F.try_element_at(segs, F.lit(k + 2))
        return (
            F.when(inside & (F.size(segs) >= k + 2) & leaf.rlike("^[0-9]+$"), leaf)
            .when(inside & (F.size(segs) >= k + 1), section)
            .otherwise(F.lit("root"))
        )

    return let(segments(url), pick)


def in_scope(url: Url, profile: UrlProfile, root: str | None, follow_others: bool) -> Column:
    """Host ends with the domain, path holds the listing prefix (and its root section)."""

    def test(a: Column) -> Column:
        p = _no_params(a[PATH])
        keep = F.lower(a[NETLOC]).endswith(profile.domain) & p.contains(profile.listing_prefix)
        if not follow_others and root:
            keep = (
                keep
                & p.startswith(profile.listing_prefix)
                & p.contains(f"{profile.listing_prefix}/{root}")
            )
        return keep & (p != profile.listing_prefix)

    return with_parts(url, test)


def form_encode(value: Column) -> Column:
    """Query encoding with ``+`` for a blank; ``~`` stays, ``*`` is escaped."""
    return F.replace(
        F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def form_decode(value: Column) -> Column:
    plain = F.replace(value, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(value), plain)


def with_query_param(url: Url, name: str, value: str) -> Column:
    """Drop every param called ``name`` (any case) and append ``name=value`` last.

    Null when the URL is not http(s) or the value is blank.
    """
    value = value.strip()
    if not value:
        return F.lit(None).cast("string")

    def decoded(pair: Column) -> Column:
        return F.struct(
            form_decode(F.regexp_extract(pair, "(?s)^([^=]*)", 1)).alias("k"),
            form_decode(F.regexp_extract(pair, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        )

    def build(a: Column) -> Column:
        pairs = F.transform(F.filter(F.split(a[QUERY], "&"), lambda p: p != ""), decoded)
        kept = F.transform(
            F.filter(pairs, lambda p: F.lower(p["k"]) != name.lower()),
            lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"])),
        )
        added = F.array(F.concat(form_encode(F.lit(name)), F.lit("="), form_encode(F.lit(value))))
        out = F.concat(
            F.lower(a[SCHEME]),
            F.lit("://"),
            a[NETLOC],
            a[PATH],
            F.lit("?"),
            F.array_join(F.concat(kept, added), "&"),
            _prefixed("#", a[FRAGMENT]),
        )
        return F.when(F.lower(a[SCHEME]).isin("http", "https"), out)

    return with_parts(url, build)


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise(F.lit(""))


def _without_dots(segs: Column) -> Column:
    """Resolve ``.`` and ``..`` over path segments; the last dot leaves a slash."""
    walked = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(F.element_at(segs, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(walked, tail)


def _joined_path(base_path: Column, own_path: Column) -> Column:
    """Path of a relative or rooted reference against the base path."""
    stem = F.split(F.regexp_replace(base_path, "/?[^/]*$", ""), "/")
    own = F.split(own_path, "/")

    def tidy(segs: Column) -> Column:
        # Empty segments inside the path vanish; the first and last stay.
        return F.filter(segs, lambda s, i: (s != "") | (i == 0) | (i == F.size(segs) - 1))

    segs = F.when(own_path.startswith("/"), own).otherwise(let(F.concat(stem, own), tidy))
    new = let(segs, lambda s: F.array_join(_without_dots(s), "/"))
    return F.regexp_replace(new, "^(?!/)", "/")


def resolve(base: Url, href: Url) -> Column:
    """Absolute URL of ``href`` seen on page ``base``."""

    def build(b: Column, h: Column) -> Column:
        root = F.concat(F.lower(b[SCHEME]), F.lit("://"), b[NETLOC])
        bare = h[PATH] == ""
        new_path = F.when(bare, b[PATH]).otherwise(_joined_path(b[PATH], h[PATH]))
        q = F.when(bare & (h[QUERY] == ""), b[QUERY]).otherwise(h[QUERY])
        relative = F.concat(root, new_path, _prefixed("?", q), _prefixed("#", h[FRAGMENT]))
        own_scheme = F.lower(h[SCHEME])
        return (
            F.when((own_scheme != "") & (own_scheme != F.lower(b[SCHEME])), col(href))
            .when((h[NETLOC] != "") & (own_scheme != ""), col(href))
            .when(h[NETLOC] != "", F.concat(F.lower(b[SCHEME]), F.lit(":"), col(href)))
            .otherwise(relative)
        )

    return with_parts(base, lambda b: with_parts(href, lambda h: build(b, h)))
