"""Text jobs over whole tables: clean-up, keywords, repetition, copy checks.

A document is one row, so all of this is narrow: arrays inside the row instead
of explode, group and collect. Only repetition needs Python, in Arrow batches:
its rules are arithmetic over all pairs of a batch (see functions/repeats.py).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import repeats as R
from shelfspark.functions import text as X
from shelfspark.functions.core import collapse_ws, contains_any, let, strip_ws
from shelfspark.profiles import (
    CLOSING_BANNED_PHRASES, DESCRIPTION_FEATURES, DESCRIPTION_INTRO, DESCRIPTION_OUTRO,
    DESCRIPTION_REASONS,
)


def phrase_flags(df: DataFrame, column: str, phrases: Sequence[str], out: str) -> DataFrame:
    """Does the text hold any of the phrases, ignoring case?"""
    return df.withColumn(out, contains_any(F.lower(F.coalesce(column, F.lit(""))), phrases))


def cut_noise(df: DataFrame, column: str, out: str, tokens=X.NOISE_TOKENS, longest=X.NOISE_MAX):
    return df.withColumn(out, X.cut_noise(F.col(column), tokens, longest))


def strip_links(
    df: DataFrame, column: str, out: str, keywords: Column | None = None, ascii_only: bool = False,
    longest: int = X.MAX_BODY, paragraphs: int = X.PARAGRAPHS, most: int = X.MAX_KEYWORDS, longest_tag: int = X.MAX_TAG,
) -> DataFrame:
    """Text without links, with a keyword tail; the ASCII form is re-paragraphed.

    Limits, of all of which 0 means none: characters of the result, paragraphs (of the ASCII
    form), keywords in the tail, characters of a tag.
    """
    body = X.without_links(F.col(column), ascii_only)
    if ascii_only:
        body = let(body, lambda b: X.paragraphs(b, paragraphs))
    return df.withColumn(out, X.with_tail(body, keywords, longest, most, longest_tag))


def suffix_title(df: DataFrame, column: str, out: str, **options) -> DataFrame:
    return df.withColumn(out, X.suffix_title(F.col(column), **options))


def derive_keywords(
    df: DataFrame, title: Column, description: Column, k: int = 12, out: str = "keywords"
) -> DataFrame:
    return df.withColumn(out, X.keywords(title, description, k))


def hashtags(df: DataFrame, words: Column, out: str = "tags") -> DataFrame:
    return df.withColumn(out, X.hashtags(X.clean_tokens(words)))


def explode_sentences(
    df: DataFrame, key: str, column: str, end: str = X.SENTENCE_END, weak: bool = True
) -> DataFrame:
    """One row per sentence, 0-based position."""
    parts = X.sentences(F.col(column), end, weak)
    return df.select(key, F.posexplode(parts).alias("idx", "sentence")).withColumn(
        "idx", F.col("idx").cast("bigint")
    )


def _keyed(column: str) -> Column:
    """The sentences with a match key, as array<struct<raw, key>>."""
    parts = F.transform(X.sentences(F.col(column)), lambda p: F.struct(p.alias("raw"), X.match_key(p).alias("key")))
    return F.filter(parts, lambda s: s["key"] != "")


def repeat_pairs(
    df: DataFrame, key: str, column: str, window: int = 10, similar: bool = True
) -> DataFrame:
    """(key, idx, prev_idx) of sentences that repeat one of the ``window`` before.

    Positions count sentences with a non-blank match key. ``similar=False``
    leaves out the similarity rule. No self-join and no shuffle: only pairs that
    repeat leave the document's row.
    """
    found = R.pairs(F.transform(_keyed(column), lambda s: s["key"]), window, similar)
    return df.select(key, found.alias("_p")).select(key, F.inline("_p"))


def drop_repeats(
    df: DataFrame, column: str, window: int = 10, similar: bool = True, out: str = "text_kept"
) -> DataFrame:
    """Greedy clean-up: a sentence goes when it repeats one of the last ``window``
    kept ones. Adds the text and the number of removed sentences.

    ``similar=False`` is the equal-key rule. Which sentences stay is told by index; their
    text is not moved.
    """
    df = df.withColumn("_s", _keyed(column))
    flags = R.kept(F.transform("_s", lambda s: s["key"]), max(1, window), True if similar else None)
    df = df.withColumn("_f", flags)
    stays = F.filter("_s", lambda s, i: F.get("_f", i))
    df = df.withColumn("_k", F.transform(stays, lambda s: s["raw"]))
    some = F.size("_k") > 0
    return (
        df.withColumn("removed", F.when(some, F.size("_s") - F.size("_k")).otherwise(0).cast("bigint"))
        .withColumn(out, F.when(some, F.array_join("_k", " ")).otherwise(collapse_ws(column)))
        .drop("_s", "_f", "_k")
    )


def ensure_lines(
    df: DataFrame,
    column: str,
    opening: str = "",
    closing: str = "",
    out: str = "text_out",
    similar: bool = True,
    phrases: Sequence[str] = CLOSING_BANNED_PHRASES,
) -> DataFrame:
    """Opening line first, closing line last, each only where it is missing.

    Without a closing line, sentences with a banned closing phrase are removed.
    """
    df = _with_opening(df, column, opening, out, similar)
    if closing.strip():
        return df.withColumn(out, X.with_closing(F.col(out), closing, phrases))
    return df.withColumn(out, X.without_banned(F.col(out), phrases))


def _with_opening(df: DataFrame, column: str, opening: str, out: str, similar: bool) -> DataFrame:
    line = opening.strip()
    body = strip_ws(F.coalesce(F.col(column), F.lit("")))
    if not line:
        return df.withColumn(out, body)
    df = df.withColumn("_body", body).withColumn(
        "_first", F.coalesce(F.try_element_at(X.sentences(F.col("_body")), F.lit(1)), F.lit(""))
    )
    df = df.withColumn("_f", X.match_key(F.col("_first"))).withColumn("_h", X.match_key(F.lit(line)))
    first, hook = F.col("_f"), F.col("_h")
    present = (hook != "") & X.match_key(F.col("_body")).contains(hook)
    three = lambda k: F.slice(X.words_of(k), 1, 3)
    lead = (F.size(three(hook)) == 3) & (three(hook) == three(first))
    df = df.withColumn("_known", present | lead | X.has_opening_signal(F.col("_first")))
    ask = F.when(~F.col("_known") & (first != "") & (hook != ""), F.array(hook, first))
    df = df.withColumn("_repeats", R.pairs(F.coalesce(ask, F.array().cast("array<string>")), 1, similar))
    df = df.withColumn("_known", F.col("_known") | (F.size("_repeats") > 0))
    start = line if line[-1] in ".!?" else line + "."
    new = (
        F.when(F.col("_body") == "", F.lit(line))
        .when(F.col("_known"), F.col("_body"))
        .otherwise(F.concat(F.lit(start + " "), F.col("_body")))
    )
    return df.withColumn(out, new).drop("_body", "_first", "_f", "_h", "_repeats", "_known")


def ensure_lines_in_segments(
    segments: DataFrame, key: str, order: str, column: str, opening: str = "", closing: str = "",
    similar: bool = True,
) -> DataFrame:
    """Opening on a script's first segment, closing on its last."""
    ends = segments.groupBy(key).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    df = segments.join(ends, key)
    df = _with_opening(df, column, opening, "_opened", similar)
    line = F.when(F.col(order) == F.col("_lo"), F.col("_opened")).otherwise(F.col(column))
    df = df.withColumn(column, line)
    if closing.strip():
        ended = F.when(
            F.col(order) == F.col("_hi"), X.with_closing(F.col(column), closing)
        ).otherwise(F.col(column))
    else:
        ended = X.without_banned(F.col(column))
    return df.withColumn(column, ended).drop("_lo", "_hi", "_opened")


def word_budget(df: DataFrame, text: str, seconds: Column) -> DataFrame:
    """Word count against the range that fits a narration of ``seconds``."""
    whole = lambda c: F.bround(c, 0).cast("bigint")
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    hint = clamp(whole(F.greatest(F.lit(5.0), seconds.cast("double")) * F.lit(2.45)), 95, 280)
    df = df.withColumn("words", F.regexp_count(text, F.lit(X.NOT_BLANK)).cast("bigint"))
    df = df.withColumn("words_hint", hint.cast("bigint"))
    low = clamp(whole(F.col("words_hint") * F.lit(0.92)), 85, 260)
    df = df.withColumn("words_min", low.cast("bigint"))
    high = F.greatest(
        F.col("words_min") + 18, F.least(F.lit(320), whole(F.col("words_hint") * F.lit(1.08)))
    )
    df = df.withColumn("words_max", high.cast("bigint"))
    return df.withColumn(
        "fit",
        F.when(F.col("words") < F.col("words_min"), "short")
        .when(F.col("words") > F.col("words_max"), "long")
        .otherwise("ok"),
    )


def json_from_text(
    df: DataFrame, column: str, out: str = "json_text", schema: str | None = None
) -> DataFrame:
    """JSON object found in free text, as text or read with a schema."""
    df = df.withColumn(out, X.json_text(F.col(column)))
    return df if schema is None else df.withColumn(out, F.from_json(out, schema))


def classify_errors(df: DataFrame, message: str, code: str | None = None) -> DataFrame:
    kinds = X.error_kinds(F.col(message), None if code is None else F.col(code))
    return df.withColumn("_k", kinds).select(*df.columns, "_k.*")


def retry_decision(
    df: DataFrame,
    message: str,
    attempt: Column,
    max_attempts: int,
    base: float = 3.0,
    cap: float = 12.0,
    code: str | None = None,
) -> DataFrame:
    """Adds decision (``raise`` or ``wait``) and wait_seconds."""
    kinds = classify_errors(df, message, code)
    asked = F.greatest(F.lit(float(base)), X.retry_delay(F.col(message), base))
    limit, soft = F.col("rate_limit"), F.col("transient")
    gives_up = (
        ~(limit | soft)
        | (limit & F.col("daily_quota"))
        | (attempt >= max(1, max_attempts))
        | (limit & (asked > cap))
    )
    wait = F.when(limit, asked).otherwise(F.lit(max(1.0, base)))
    return kinds.withColumn(
        "decision", F.when(gives_up, "raise").otherwise("wait")
    ).withColumn("wait_seconds", F.when(~gives_up, wait))


def split_tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    """Unique tokens per row in order, with their masked form."""
    out = df.select(key, F.posexplode(X.tokens(F.col(column))).alias("pos", "token"))
    return out.withColumn("pos", F.col("pos").cast("bigint")).withColumn(
        "masked", X.mask(F.col("token"))
    )


def compose_description(
    df: DataFrame, column: str, prefix: str = "", out: str = "description_out", body_max: int = 1500,
    longest: int = X.MAX_BODY, noise_max: int = X.NOISE_MAX,
) -> DataFrame:
    """Prefix line and noise-free body, links removed.

    Limits in characters, of all of which 0 means none: the body, the result, the noise-free text.
    """
    body = X.cut_noise(F.col(column), longest=noise_max)
    body = F.trim(F.left(body, F.lit(body_max)) if body_max else body)
    parts = F.filter(F.array(F.lit(prefix.strip()), body), lambda p: p != "")
    return df.withColumn(
        out, X.with_tail(X.without_links(F.array_join(parts, "\n\n")), None, longest)
    )


def template_description(
    df: DataFrame, title: str, column: str, keywords: Column | None = None, prefix: str = "",
    out: str = "description_out", longest: int = X.MAX_BODY, paragraphs: int = X.PARAGRAPHS,
    most: int = X.MAX_KEYWORDS, longest_tag: int = X.MAX_TAG,
) -> DataFrame:
    """Description from the title and the first four sentences of the text.

    Limits, of all of which 0 means none: characters of the result, paragraphs, keywords in
    the tail, characters of a tag.
    """
    join = lambda a, n: F.array_join(F.slice(a, n, 2), " ")

    def assemble(points: Column) -> Column:
        return F.array_join(
            F.array_compact(F.array(
                F.concat(collapse_ws(title), F.lit(DESCRIPTION_INTRO)),
                F.when(F.size(points) > 0, F.concat(F.lit(DESCRIPTION_FEATURES), join(points, 1))),
                F.when(F.size(points) > 2, F.concat(F.lit(DESCRIPTION_REASONS), join(points, 3))),
                F.lit(DESCRIPTION_OUTRO),
            )),
            "\n\n",
        )

    body = let(X.sentences(F.col(column), X.PLAIN_END, weak=False), assemble)
    body = let(X.without_links(body, ascii_only=True), lambda b: X.paragraphs(b, paragraphs))
    text = X.with_tail(body, keywords, longest, most, longest_tag)
    lead = prefix.strip()
    if lead:
        text = let(text, lambda t: F.when(F.lower(t).contains(lead.lower()), t).otherwise(
            strip_ws(F.concat(F.lit(lead + "\n\n"), t))
        ))
        text = X.rstrip(F.left(text, F.lit(longest)) if longest else text)
    return df.withColumn(out, text)
