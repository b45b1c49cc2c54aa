"""Text queries over documents, events and parts, whole texts throughout."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.operators import text as O
from shelfspark.profiles import (
    DAILY_TOKENS, DESCRIPTION_FEATURES, DESCRIPTION_INTRO, DESCRIPTION_OUTRO, DESCRIPTION_REASONS,
    NO_AUDIO_TOKENS, RATE_TOKENS, STOPWORDS, TRANSIENT_TOKENS,
)
from shelfspark.registry.base import collapse, lit, table

STRIP = r"'^[\s\p{Z}\x{85}\x0b]+|[\s\p{Z}\x{85}\x0b]+$'"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {STRIP}, '', 'g')"


def rstrip_sql(text: str) -> str:
    return rf"regexp_replace({text}, '[\s\p{{Z}}\x{{85}}\x0b]+$', '')"


def split_sql(text: str, end: str = ".!?।") -> str:
    """List of non-blank parts of collapsed text after sentence ends."""
    return (
        f"list_filter(string_split(regexp_replace({text}, '([{end}])\\s+', '\\1' || chr(1), 'g'), chr(1)),"
        " lambda p: p <> '')"
    )


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# CTEs: s(doc_id, body, parts) and e(doc_id, idx, sentence).
SENT = f"""
b AS (SELECT doc_id, {collapse('text')} AS body FROM documents),
s0 AS (SELECT doc_id, body, {split_sql('body')} AS p FROM b),
s AS (
  SELECT doc_id, body, CASE WHEN body = '' THEN [] WHEN len(p) > 1 THEN p
    ELSE CASE WHEN len(list_filter(string_split_regex(body, '\\s*[,:;]\\s*'), lambda q: q <> '')) > 0
      THEN list_filter(string_split_regex(body, '\\s*[,:;]\\s*'), lambda q: q <> '') ELSE [body] END
    END AS parts FROM s0),
e AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS idx FROM s)
"""
KEY = "trim(regexp_replace(lower(sentence), '[\"''`“”‘’]', '', 'g'), ' .,!?:;|')"


def sentences(spark, sf):
    return O.explode_sentences(_docs(spark, sf), "doc_id", "text")


NOISE = ("the ", "und ", "### ", " token = ", "que ")


def cut_noise(spark, sf):
    return O.cut_noise(_docs(spark, sf), "text", "body", NOISE, 2200).select("doc_id", "body")


def _cut_sql(text: str, tokens=NOISE) -> str:
    steps = [f"c0 AS (SELECT doc_id, {collapse(text)} AS b FROM documents)"]
    for i, token in enumerate(tokens):
        t = lit(token)
        steps.append(
            f"c{i + 1} AS (SELECT doc_id, CASE WHEN strpos(b, {t}) > 1 "
            f"THEN rtrim(left(b, strpos(b, {t}) - 1)) ELSE b END AS b FROM c{i})"
        )
    steps.append(
        f"cut AS (SELECT doc_id, CASE WHEN length(b) > 2200 THEN rtrim(left(b, 2200)) || '...' "
        f"ELSE b END AS body FROM c{len(tokens)})"
    )
    return ",\n".join(steps)


# Links and labels put into documents, which hold none themselves.
def _with_links(spark, sf):
    return _docs(spark, sf).withColumn(
        "text",
        F.concat(
            F.lit("Product URL : x\r\n\r\n\r\n\r\n"), F.regexp_replace("text", r"\. ", ".\twww.a.example/é "),
            F.lit("\naffiliate  tag: t-21\nsee HTTPS://b.example/?q=1&r=2 end  "),
        ),
    )


LINKED = r"""
x AS (
  SELECT doc_id, 'Product URL : x' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10)
    || chr(13) || chr(10) || replace(text, '. ', '.' || chr(9) || 'www.a.example/é ')
    || chr(10) || 'affiliate  tag: t-21' || chr(10) || 'see HTTPS://b.example/?q=1&r=2 end  ' AS t FROM documents)
"""


def links_sql(text: str, ascii_only: bool = False) -> str:
    t = f"replace({text}, chr(13), chr(10))"
    if ascii_only:
        t = rf"regexp_replace({t}, '[^\x00-\x7F]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)https?://[^\s\p{{Z}}]+', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)www\.[^\s\p{{Z}}]+', '', 'g')"
    t = rf"regexp_replace({t}, '(?im)^\s*(product\s*url|affiliate\s*tag)\s*:.*$', '', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(rf"regexp_replace({t}, '[ \t]+', ' ', 'g')")


def strip_links(spark, sf):
    words = F.array(F.lit("Steel Pan!"), F.lit("steel pan"), F.lit("é"), F.lit("#Pots & Pans"), F.lit("-"))
    return O.strip_links(_with_links(spark, sf), "text", "body", words).select("doc_id", "body")


_TAIL = "Keywords: Steel Pan, #Pots & Pans, -' || chr(10) || chr(10) || '#SteelPan #PotsPans"
STRIP_LINKS_SQL = f"""
WITH {LINKED}
SELECT doc_id, {rstrip_sql(f"left({strip_sql(links_sql('t') + " || chr(10) || chr(10) || '" + _TAIL + "'")}, 5000)")} AS body
FROM x"""


def strip_links_ascii(spark, sf):
    return O.strip_links(_with_links(spark, sf), "text", "body", ascii_only=True).select("doc_id", "body")


def paragraphs_ctes(source: str) -> str:
    """CTE pb(doc_id, body) of the re-paragraphed ``source``(doc_id, body)."""
    return rf"""
pl AS (
  SELECT doc_id, body, list_transform(list_filter(string_split(body, chr(10)),
      lambda q: {strip_sql('q')} <> ''),
    lambda q: trim({collapse('q')}, ' -•' || chr(9))) AS ls FROM {source}),
ps AS (
  SELECT doc_id, body, ls, {split_sql(collapse("array_to_string(ls, ' ')"), '.!?')} AS ss FROM pl),
pp AS (
  SELECT doc_id, body, list_filter(CASE WHEN len(ls) > 1 THEN ls
    WHEN len(ss) >= 5 THEN [array_to_string(ss[1:2], ' '), array_to_string(ss[3:4], ' '),
      array_to_string(ss[5:], ' ')]
    ELSE [array_to_string(ss[1:2], ' '), array_to_string(ss[3:], ' ')] END, lambda q: q <> '') AS ps FROM ps),
pb AS (
  SELECT doc_id, CASE WHEN len(ps) > 0 THEN array_to_string(ps[1:4], chr(10) || chr(10)) ELSE body END AS body
  FROM pp)
"""


STRIP_ASCII_SQL = (
    f"WITH {LINKED}, la AS (SELECT doc_id, {links_sql('t', True)} AS body FROM x), "
    + paragraphs_ctes("la")
    + f"SELECT doc_id, {rstrip_sql('left(body, 5000)')} AS body FROM pb"
)


# ---- the same without the limits of length and number ------------------------------
def _uncut(sql: str) -> str:
    """The SQL of a cut form without its limits."""
    for limit in ("2200", "5000", "1500"):
        sql = sql.replace(limit, "2000000000")
    return sql.replace("ps[1:4]", "ps")


def cut_noise_whole(spark, sf):
    return O.cut_noise(_docs(spark, sf), "text", "body", NOISE, 0).select("doc_id", "body")


def strip_links_whole(spark, sf):
    words = F.array(F.lit("Steel Pan!"), F.lit("steel pan"), F.lit("é"), F.lit("#Pots & Pans"), F.lit("-"))
    return O.strip_links(_with_links(spark, sf), "text", "body", words, longest=0, most=0, longest_tag=0).select("doc_id", "body")


def strip_links_ascii_whole(spark, sf):
    out = O.strip_links(_with_links(spark, sf), "text", "body", ascii_only=True, longest=0, paragraphs=0)
    return out.select("doc_id", "body")


def compose_description_whole(spark, sf):
    out = O.compose_description(
        _docs(spark, sf), "text", " Deal of the day ", "description", body_max=0, longest=0, noise_max=0
    )
    return out.select("doc_id", "description")


def template_description_whole(spark, sf):
    docs = _docs(spark, sf).withColumn("title", F.substring_index("text", " ", 3))
    words = X.keywords(F.lit("Steel Pan, The Best"), F.col("text"))
    out = O.template_description(docs, "title", "text", words, "Watch till the end", "description", longest=0, paragraphs=0)
    return out.select("doc_id", "description")


def suffix_title(spark, sf):
    """Titles from document starts; some already end in a suffix variant."""
    first = F.substring_index("text", "\n", 1)
    title = F.when(F.col("doc_id") % 5 == 0, F.concat(first, F.lit(" ( Malayalam ) "))).when(
        F.col("doc_id") % 5 == 1, F.lit("  ")
    ).otherwise(first)
    return O.suffix_title(_docs(spark, sf).withColumn("t", title), "t", "title", prefix="Look") \
        .select("doc_id", "title")


SUFFIX_SQL = rf"""
WITH t AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN split_part(text, chr(10), 1) || ' ( Malayalam ) '
    WHEN doc_id % 5 = 1 THEN '  ' ELSE split_part(text, chr(10), 1) END AS t FROM documents),
c AS (SELECT doc_id, 'Look | ' || coalesce(nullif({collapse('t')}, ''), 'Product Review') AS c FROM t),
v AS (SELECT doc_id, trim(regexp_replace({collapse('c')}, '(?i)\(\s*malayalam\s*\)\s*$', '')) AS v FROM c)
SELECT doc_id, trim(CASE WHEN length(v) > 88 THEN rtrim(left(v, 88), ' -|,:;') ELSE v END || ' (MALAYALAM)') AS title
FROM v"""


def keywords(spark, sf):
    out = O.derive_keywords(_docs(spark, sf), F.lit("Steel Pan, The Best"), F.col("text"))
    return out.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


_STOP = ", ".join(lit(w) for w in STOPWORDS)
KEYWORD_CTES = rf"""
kt AS (SELECT doc_id, 'Steel Pan, The Best ' || text AS t FROM documents),
kp AS (
  SELECT doc_id, 0 AS grp, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (
    SELECT doc_id, list_transform(string_split_regex(t, '[,\n\r|.;:()\-]+'), lambda c: {collapse('c')}) AS x FROM kt)),
ks AS (
  SELECT doc_id, 1 AS grp, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '[A-Za-z][A-Za-z0-9+\-]{{2,}}') AS x FROM kt)),
ka AS (
  SELECT * FROM kp WHERE regexp_matches(w, '[A-Za-z]') AND length(w) <= 42
    AND len(string_split(w, ' ')) BETWEEN 2 AND 5
  UNION ALL SELECT * FROM ks),
kc AS (SELECT doc_id, grp, i, trim(regexp_replace(w, '[^A-Za-z0-9 #&+\-]', '', 'g')) AS w FROM ka),
kf AS (
  SELECT doc_id, lower(w) AS l, min_by(w, (grp, i)) AS w, min((grp, i)) AS o FROM kc
  WHERE length(w) > 2 AND lower(w) NOT IN ({_STOP}) GROUP BY doc_id, lower(w)),
kr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS rn FROM kf),
kk AS (SELECT doc_id, w, rn FROM kr WHERE rn <= 12)
"""


def hashtags(spark, sf):
    """Tags of the lines of every document: cleaned, unique ignoring case, first twelve."""
    out = O.hashtags(_docs(spark, sf), F.split("text", "\n"))
    return out.select("doc_id", F.array_join("tags", " ").alias("tags"))


HASHTAGS_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (
    SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
c AS (SELECT doc_id, i, {strip_sql(r"regexp_replace(w, '[^A-Za-z0-9 #&\\-]', '', 'g')")} AS w FROM l),
u AS (SELECT doc_id, lower(w) AS k, min_by(w, i) AS w, min(i) AS i FROM c WHERE w <> '' GROUP BY doc_id, lower(w)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM u),
t AS (SELECT doc_id, rn, '#' || left(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'), 30) AS t FROM r WHERE rn <= 12)
SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY rn), '') AS tags
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id AND length(t) > 1 GROUP BY d.doc_id"""


# ---- repetition ---------------------------------------------------------------------
WINDOW = 10


def repeat_pairs(spark, sf):
    return O.repeat_pairs(_docs(spark, sf), "doc_id", "text", WINDOW, similar=False)


def repeat_pairs_similar(spark, sf):
    return O.repeat_pairs(_docs(spark, sf), "doc_id", "text", WINDOW, similar=True)


REPEAT_SQL = "WITH " + SENT + f""",
k0 AS (SELECT doc_id, idx, {KEY} AS k FROM e),
k AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS i,
    list_filter(string_split(k, ' '), lambda w: w <> '') AS w FROM k0 WHERE k <> ''),
p AS (
  SELECT a.doc_id, a.i, b.i AS j, a.k AS ak, b.k AS bk, a.w AS aw, b.w AS bw,
    least(len(a.w), len(b.w)) AS fewer, greatest(len(a.w), len(b.w)) AS more
  FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.i < a.i AND b.i >= a.i - {WINDOW}),
q AS (
  SELECT *, coalesce(list_position(list_transform(range(1, fewer + 1), lambda n: aw[n] = bw[n]), false) - 1, fewer)
    AS lead FROM p)
SELECT doc_id, i AS idx, j AS prev_idx FROM q
WHERE ak = bk
  OR (fewer >= 4 AND CASE WHEN len(aw) <= len(bw) THEN starts_with(bk, ak) ELSE starts_with(ak, bk) END
      AND fewer / more >= 0.45::DOUBLE)
  OR (lead >= 4 AND lead / fewer >= 0.55::DOUBLE)
  OR (fewer >= 3 AND len(list_intersect(aw, bw)) / least(len(list_distinct(aw)), len(list_distinct(bw))) >= 0.88::DOUBLE)"""


def drop_repeats(spark, sf):
    """Equal-key rule with a window that covers every document: first of each key stays."""
    out = O.drop_repeats(_docs(spark, sf), "text", 1_000_000, similar=False)
    return out.select("doc_id", "text_kept", "removed")


DROP_SQL = "WITH " + SENT + f""",
k AS (SELECT doc_id, idx, sentence, {KEY} AS k FROM e),
f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY idx) AS rn FROM k WHERE k <> ''),
a AS (
  SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) FILTER (rn = 1) AS kept,
    count(*) FILTER (rn > 1) AS removed FROM f GROUP BY doc_id)
SELECT b.doc_id, coalesce(kept, body) AS text_kept, coalesce(removed, 0)::BIGINT AS removed
FROM b LEFT JOIN a ON b.doc_id = a.doc_id"""


def drop_repeats_window(spark, sf):
    """Equal-key rule among the last three kept sentences, so that later repeats stay."""
    out = O.drop_repeats(_docs(spark, sf), "text", 3, similar=False)
    return out.select("doc_id", "text_kept", "removed")


DROP_WINDOW_SQL = "WITH " + SENT + f""",
k AS (SELECT doc_id, idx, sentence, {KEY} AS k FROM e),
f AS (
  SELECT doc_id, list([k || chr(1) || sentence] ORDER BY idx) AS xs FROM k WHERE k <> '' GROUP BY doc_id),
a AS (
  SELECT doc_id, len(xs) AS n, list_reduce(xs, lambda acc, x: CASE WHEN list_contains(
    list_transform(acc[greatest(len(acc) - 2, 1):len(acc)], lambda y: split_part(y, chr(1), 1)), split_part(x[1], chr(1), 1))
    THEN acc ELSE list_concat(acc, x) END) AS kept FROM f)
SELECT b.doc_id, coalesce(array_to_string(list_transform(kept, lambda y: split_part(y, chr(1), 2)), ' '), body) AS text_kept,
  coalesce(n - len(kept), 0)::BIGINT AS removed
FROM b LEFT JOIN a ON b.doc_id = a.doc_id"""


def drop_repeats_similar(spark, sf):
    out = O.drop_repeats(_docs(spark, sf), "text", 12, similar=True)
    return out.select("doc_id", "text_kept", "removed")


OPENING, CLOSING = "Stop and look", "Buy it now"
BANNED = ("the this", "und der", "avec")


def ensure_lines(spark, sf):
    out = O.ensure_lines(_docs(spark, sf), "text", OPENING, CLOSING, similar=False, phrases=BANNED)
    return out.select("doc_id", "text_out")


_SIGNALS = " OR ".join(f"contains(lower(first), {lit(p)})" for p in X.OPENING_PHRASES)
_BAN = lambda t: "(" + " OR ".join(f"contains(lower({t}), {lit(p)})" for p in BANNED) + ")"
ENSURE_SQL = "WITH " + SENT + rf""",
o0 AS (
  SELECT d.doc_id, {strip_sql('d.text')} AS body, s.body AS flat, coalesce(s.parts[1], '') AS first
  FROM documents d JOIN s ON d.doc_id = s.doc_id),
o1 AS (
  SELECT *, trim(regexp_replace(lower(first), '["''`“”‘’]', '', 'g'), ' .,!?:;|') AS fk,
    trim(regexp_replace(lower(flat), '["''`“”‘’]', '', 'g'), ' .,!?:;|') AS bk FROM o0),
o2 AS (
  SELECT doc_id, CASE WHEN body = '' THEN 'Stop and look'
    WHEN contains(bk, 'stop and look') OR starts_with(fk || ' ', 'stop and look ') OR {_SIGNALS}
      OR len(list_intersect(string_split(fk, ' '), ['stop', 'and', 'look'])) = 3
      OR (len(list_filter(string_split(fk, ' '), lambda w: w <> '')) >= 3 AND
          len(list_intersect(string_split(fk, ' '), ['stop', 'and', 'look']))
          / least(3, len(list_distinct(string_split(fk, ' ')))) >= 0.88::DOUBLE)
    THEN body ELSE 'Stop and look. ' || body END AS t FROM o1),
o3 AS (
  SELECT doc_id, t, CASE WHEN {_BAN('t')} THEN array_to_string(list_filter(list_transform(string_split(
      regexp_replace(t, '([.!?।])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda p: {strip_sql('p')}),
      lambda p: p <> '' AND NOT {_BAN('p')}), ' ') ELSE t END AS base FROM o2)
SELECT doc_id, CASE WHEN contains(lower(t), 'buy it now') THEN t ELSE {strip_sql(
    "(CASE WHEN base = '' OR regexp_matches(base, '[.!?]$') THEN base ELSE base || '.' END) || ' Buy it now'")}
  END AS text_out FROM o3"""


# ---- numbers, JSON, errors, tokens --------------------------------------------------
def word_budget(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    out = O.word_budget(docs, "text", F.col("n_chars") / 20)
    return out.select("doc_id", "words", "words_hint", "words_min", "words_max", "fit")


WORD_BUDGET_SQL = r"""
WITH h AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^\s\p{Z}\x{85}\x0b]+'))::BIGINT AS words,
    greatest(95, least(280, round_even(greatest(5::DOUBLE, n_chars / 20::DOUBLE) * 2.45::DOUBLE, 0)))::BIGINT
      AS words_hint FROM documents),
m AS (
  SELECT *, greatest(85, least(260, round_even(words_hint * 0.92::DOUBLE, 0)))::BIGINT AS words_min FROM h),
x AS (
  SELECT *, greatest(words_min + 18, least(320, round_even(words_hint * 1.08::DOUBLE, 0)))::BIGINT AS words_max
  FROM m)
SELECT *, CASE WHEN words < words_min THEN 'short' WHEN words > words_max THEN 'long' ELSE 'ok' END AS fit FROM x"""


def json_from_text(spark, sf):
    """Event properties the way free text carries them: raw, fenced, in prose, in a list, broken."""
    p, kind = F.col("props"), F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit("  "), p))
        .when(kind == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(kind == "purchase", F.concat(F.lit('ok {"a":"}\\"{","b":'), p, F.lit("} tail {")))
        .when(kind == "signup", F.concat(F.lit("["), p, F.lit("]")))
        .otherwise(F.concat(F.lit("no {"), p))
    )
    out = O.json_from_text(table(spark, sf, "events").withColumn("t", text), "t")
    return out.select("event_id", "json_text")


JSON_SQL = r"""
SELECT event_id, CASE event_type WHEN 'view' THEN props WHEN 'click' THEN props
  WHEN 'purchase' THEN '{"a":"}\"{","b":' || props || '}' WHEN 'signup' THEN props END AS json_text
FROM events"""


def jsonl_log(spark, sf):
    """Event properties as a line log with broken and keyless lines."""
    from shelfspark.sources.logs import parse_log_lines

    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{bad "), F.col("props"))).when(
        F.col("event_type") == "view", F.lit("  ")
    ).when(F.col("event_type") == "signup", F.lit('{"url":"","time":"t"}')).otherwise(
        F.format_string('{"url":"u%d","youtube_url":"v%d","time":"2024"}', "user_id", "event_id")
    )
    lines = table(spark, sf, "events").select(line.alias("value"))
    return parse_log_lines(lines).select("url", "youtube_url", "time")


JSONL_SQL = """
SELECT 'u' || user_id AS url, 'v' || event_id AS youtube_url, '2024' AS time
FROM events WHERE event_type IN ('click', 'purchase')"""


def _messages(spark, sf):
    kind, v = F.col("event_type"), F.col("value").cast("decimal(10,2)").cast("string")
    message = (
        F.when(kind == "error", F.concat(F.lit("ClientError: 429 quota, Retry in "), v, F.lit("s")))
        .when(kind == "signup", F.concat(F.lit("HTTP 503 from host after "), v, F.lit("s")))
        .when(kind == "purchase", F.concat(F.lit("RESOURCE_EXHAUSTED {'retryDelay': '"), v, F.lit("s'}")))
        .when(kind == "view", F.concat(F.lit("quota PerDay exceeded "), v))
        .otherwise(F.concat(F.lit("TTS returned no audio "), v))
    )
    return table(spark, sf, "events").withColumn("message", message)


_MESSAGES = """
m0 AS (
  SELECT event_id, event_type, value, printf('%.2f', value) AS v FROM events),
m AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'ClientError: 429 quota, Retry in ' || v || 's'
    WHEN 'signup' THEN 'HTTP 503 from host after ' || v || 's'
    WHEN 'purchase' THEN 'RESOURCE_EXHAUSTED {''retryDelay'': ''' || v || 's''}'
    WHEN 'view' THEN 'quota PerDay exceeded ' || v
    ELSE 'TTS returned no audio ' || v END AS message FROM m0)
"""


def _has(text: str, tokens) -> str:
    return "(" + " OR ".join(f"contains(upper({text}), {lit(t)})" for t in tokens) + ")"


def classify_errors(spark, sf):
    events = O.classify_errors(_messages(spark, sf).select("event_id", "message"), "message")
    docs = O.classify_errors(_docs(spark, sf).withColumnsRenamed({"doc_id": "event_id", "text": "message"}),
                             "message")
    both = events.withColumn("origin", F.lit("event")).unionByName(docs.withColumn("origin", F.lit("doc")))
    return both.drop("message")


_KINDS = f"""
  {_has('message', RATE_TOKENS)} AS rate_limit, {_has('message', TRANSIENT_TOKENS)} AS transient,
  {_has('message', DAILY_TOKENS)} AS daily_quota, {_has('message', NO_AUDIO_TOKENS)} AS no_audio
"""
CLASSIFY_SQL = f"""
WITH {_MESSAGES},
a AS (SELECT 'event' AS origin, event_id, message FROM m UNION ALL SELECT 'doc', doc_id, text FROM documents),
k AS (SELECT origin, event_id, {_KINDS} FROM a)
SELECT *, rate_limit OR transient OR no_audio AS retriable FROM k"""


def retry_decision(spark, sf):
    out = O.retry_decision(_messages(spark, sf), "message", F.col("event_id") % 4 + 1, 4)
    return out.select("event_id", "decision", "wait_seconds")


RETRY_SQL = rf"""
WITH {_MESSAGES},
k AS (SELECT *, {_KINDS}, event_id % 4 + 1 AS attempt,
  coalesce(try_cast(nullif(regexp_extract(message, '(?i)retry in ([0-9]+(?:\.[0-9]+)?)s', 1), '') AS DOUBLE),
    try_cast(nullif(regexp_extract(message, '(?i)retryDelay[''"]?\s*:\s*''([0-9]+(?:\.[0-9]+)?)s''', 1), '')
      AS DOUBLE), 3) AS asked FROM m),
d AS (SELECT *, greatest(3::DOUBLE, asked) AS w FROM k),
g AS (
  SELECT *, NOT (rate_limit OR transient) OR (rate_limit AND daily_quota) OR attempt >= 4
    OR (rate_limit AND w > 12) AS up FROM d)
SELECT event_id, CASE WHEN up THEN 'raise' ELSE 'wait' END AS decision,
  CASE WHEN NOT up THEN CASE WHEN rate_limit THEN w ELSE 3 END END AS wait_seconds FROM g"""


def tokens(spark, sf):
    return O.split_tokens(_docs(spark, sf), "doc_id", "text")


TOKENS_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) AS i FROM (
    SELECT doc_id, string_split_regex(text, '[\s\p{Z}\x{85}\x0b,;]+') AS x FROM documents)),
u AS (SELECT doc_id, token, min(i) AS i FROM t WHERE token <> '' GROUP BY doc_id, token)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, token,
  CASE WHEN length(token) <= 8 THEN repeat('*', length(token))
    ELSE left(token, 4) || '...' || right(token, 4) END AS masked FROM u"""


def compose_description(spark, sf):
    out = O.compose_description(_docs(spark, sf), "text", " Deal of the day ", "description")
    return out.select("doc_id", "description")


COMPOSE_SQL = "WITH " + _cut_sql("text", ("window.$Nav",)) + f""",
d AS (
  SELECT doc_id, 'Deal of the day' || CASE WHEN trim(left(body, 1500)) <> ''
    THEN chr(10) || chr(10) || trim(left(body, 1500)) ELSE '' END AS t FROM cut)
SELECT doc_id, {rstrip_sql(f"left({links_sql('t')}, 5000)")} AS description FROM d"""


def template_description(spark, sf):
    docs = _docs(spark, sf).withColumn("title", F.substring_index("text", " ", 3))
    words = X.keywords(F.lit("Steel Pan, The Best"), F.col("text"))
    out = O.template_description(docs, "title", "text", words, "Watch till the end", "description")
    return out.select("doc_id", "description")


TEMPLATE_SQL = "WITH " + KEYWORD_CTES + f""",
tb AS (
  SELECT doc_id, {collapse('text')} AS body,
    {collapse("array_to_string(string_split(text, ' ')[1:3], ' ')")} AS title FROM documents),
ts AS (SELECT doc_id, title, {split_sql('body', '.!?')} AS p FROM tb),
td AS (
  SELECT doc_id, title || {lit(DESCRIPTION_INTRO)} || chr(10) || chr(10)
    || CASE WHEN len(p) > 0 THEN {lit(DESCRIPTION_FEATURES)} || array_to_string(p[1:2], ' ') || chr(10) || chr(10) ELSE '' END
    || CASE WHEN len(p) > 2 THEN {lit(DESCRIPTION_REASONS)} || array_to_string(p[3:4], ' ') || chr(10) || chr(10) ELSE '' END
    || {lit(DESCRIPTION_OUTRO)} AS t FROM ts),
tl AS (SELECT doc_id, {links_sql('t', True)} AS body FROM td), """ + paragraphs_ctes("tl") + f""",
tc AS (
  SELECT doc_id, rn, w, trim(regexp_replace(w, '[^A-Za-z0-9 #&\\\\-]', '', 'g')) AS c FROM kk),
tu AS (
  SELECT doc_id, lower(c) AS l, min_by(c, rn) AS c, min(rn) AS rn FROM tc WHERE c <> '' GROUP BY doc_id, lower(c)),
tt AS (
  SELECT doc_id, 'Keywords: ' || string_agg(c, ', ' ORDER BY rn) || chr(10) || chr(10)
    || coalesce(string_agg('#' || left(regexp_replace(c, '[^A-Za-z0-9]', '', 'g'), 30), ' ' ORDER BY rn)
         FILTER (regexp_matches(c, '[A-Za-z0-9]')), '') AS tail FROM tu GROUP BY doc_id)
SELECT doc_id, {rstrip_sql("left(CASE WHEN contains(lower(t), 'watch till the end') THEN t ELSE 'Watch till the end' || chr(10) || chr(10) || t END, 5000)")} AS description
FROM (SELECT pb.doc_id, {rstrip_sql("left(CASE WHEN tail IS NULL THEN body ELSE body || chr(10) || chr(10) || " + strip_sql('tail') + " END, 5000)")}
  AS t FROM pb LEFT JOIN tt ON pb.doc_id = tt.doc_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        sentences, cut_noise, strip_links, strip_links_ascii, suffix_title, keywords, hashtags,
        repeat_pairs, repeat_pairs_similar, drop_repeats, drop_repeats_window, drop_repeats_similar,
        ensure_lines,
        word_budget, json_from_text, jsonl_log, classify_errors, retry_decision, tokens,
        compose_description, template_description,
        cut_noise_whole, strip_links_whole, strip_links_ascii_whole, compose_description_whole, template_description_whole,
    )
}
SQL = {
    "sentences": "WITH " + SENT + "SELECT doc_id, idx::BIGINT AS idx, sentence FROM e",
    "cut_noise": "WITH " + _cut_sql("text") + "SELECT doc_id, body FROM cut",
    "strip_links": STRIP_LINKS_SQL,
    "strip_links_ascii": STRIP_ASCII_SQL,
    "suffix_title": SUFFIX_SQL,
    "keywords": "WITH " + KEYWORD_CTES
    + "SELECT doc_id, string_agg(w, ',' ORDER BY rn) AS keywords FROM kk GROUP BY doc_id",
    "hashtags": HASHTAGS_SQL,
    "repeat_pairs": REPEAT_SQL,
    "drop_repeats": DROP_SQL,
    "drop_repeats_window": DROP_WINDOW_SQL,
    "ensure_lines": ENSURE_SQL,
    "word_budget": WORD_BUDGET_SQL,
    "json_from_text": JSON_SQL,
    "jsonl_log": JSONL_SQL,
    "classify_errors": CLASSIFY_SQL,
    "retry_decision": RETRY_SQL,
    "tokens": TOKENS_SQL,
    "compose_description": COMPOSE_SQL,
    "template_description": TEMPLATE_SQL,
    "cut_noise_whole": _uncut("WITH " + _cut_sql("text") + "SELECT doc_id, body FROM cut"),
    "strip_links_whole": _uncut(STRIP_LINKS_SQL),
    "strip_links_ascii_whole": _uncut(STRIP_ASCII_SQL),
    "compose_description_whole": _uncut(COMPOSE_SQL),
    "template_description_whole": _uncut(TEMPLATE_SQL),
}
