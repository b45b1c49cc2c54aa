"""Hand-made rows: rules that the test tables do not show."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import html as H
from shelfspark.functions import text as X
from shelfspark.functions import urls as U
from shelfspark.operators import aggregates as A
from shelfspark.operators import pages as P
from shelfspark.operators import queues as Q
from shelfspark.operators import sequence as S
from shelfspark.operators import text as O
from shelfspark.operators import urls as OU
from shelfspark.profiles import STOPWORDS, LinkProfile, PageProfile, UrlProfile

SITE = UrlProfile()


def values(spark, inputs, rule):
    """One rule over several inputs, evaluated by Spark on a table of them."""
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r[0] for r in df.select("i", rule(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


# ---- URLs ---------------------------------------------------------------------
def test_canonical_section(spark):
    got = values(spark, [
        "http://WWW.Shop.example/gp/bestsellers/kitchen/12/ref=abc?pg=2#x",
        "https://shop.example", "https://shop.example/", "https://shop.example/a;p=1",
        " https://shop.example/a//", "HTTP://a.example:80/x;y/z",
    ], U.canonical_section)
    assert got == [
        "https://www.shop.example/gp/bestsellers/kitchen/12", "https://shop.example/",
        "https://shop.example/", "https://shop.example/a", "https://shop.example/a",
        "https://a.example:80/x;y/z",
    ]
    bare = values(spark, ["https://shop.example", "https://shop.example/"],
                  lambda v: U.canonical_section(v, root_slash=False))
    assert bare == ["https://shop.example", "https://shop.example/"]


def test_canonical_is_idempotent(spark):
    df = spark.createDataFrame([("http://A.b/x/ref=1?q",), ("https://c.d//",)], "url string")
    once = OU.canonicalize_urls(df)
    twice = OU.canonicalize_urls(once, "canonical_url", out="again")
    assert twice.filter("again <> canonical_url").count() == 0


def test_item_url_and_keys(spark):
    item = lambda v: U.canonical_item(v, SITE)
    assert values(spark, [
        "http://shop.example/n/dp/b07wms7twb/ref=x?th=1",
        "https://shop.example/gp/product/B07WMS7TWBZZ",
        "http://Shop.example/other?x=1#y",
    ], item) == [
        "https://shop.example/dp/B07WMS7TWB", "https://shop.example/dp/B07WMS7TWB",
        "https://shop.example/other",
    ]
    assert values(spark, [" b07wms7twb ", "B07WMS7TW"], lambda v: U.key_strict(v, SITE)) == [
        "B07WMS7TWB", ""]
    text = lambda v: U.key_in_text(v, SITE)
    assert values(spark, ["B07WMS7TWB_video_01", "B07WMS7TWB B07WMS7TWB_video_01", "éB07WMS7TW"],
                  text) == ["", "B07WMS7TWB", ""]
    assert values(spark, ["https://x/gp/product/b07wms7twb?x", "https://x/"],
                  lambda v: U.key_from_url(v, SITE)) == ["B07WMS7TWB", ""]


def test_item_key_override_wins(spark):
    df = spark.createDataFrame([("AAAAAAAAAA", "BBBBBBBBBB"), ("AAAAAAAAAA", "")], "t string, o string")
    got = [r.item_key for r in OU.item_key(df, "t", "text", override=F.col("o")).collect()]
    assert got == ["BBBBBBBBBB", "AAAAAAAAAA"]


def test_url_attributes(spark):
    page = lambda v: U.page_number(v, SITE)
    assert values(spark, ["https://a/x?pg=3", "https://a/ref=zg_bs_pg_2_kitchen", "https://a/x?pg=x"],
                  page) == [3, 2, 1]
    cluster = lambda v: U.cluster_key(v, SITE)
    base = "https://a.example"
    assert values(spark, [base + p for p in (
        "/gp/bestsellers/kitchen/123", "/gp/bestsellers/kitchen/abc", "/gp/bestsellers/kitchen", "/x")],
        cluster) == ["123", "kitchen", "kitchen", "root"]
    assert values(spark, [base + "/gp/bestsellers/Toys/1", base + "/x"],
                  lambda v: U.section_raw(v, SITE)) == ["Toys", None]
    assert values(spark, [base + "/gp/bestsellers/Toys/1", base + "/x"],
                  lambda v: U.section_or_default(v, SITE)) == ["toys", "kitchen"]


def test_page_urls(spark):
    df = spark.createDataFrame([("https://shop.example/gp/bestsellers/toys/",), ("https://shop.example",)],
                               "url string")
    got = {(r.url, r.page): r.page_url for r in OU.expand_pages(df, 2).collect()}
    assert got[("https://shop.example/gp/bestsellers/toys/", 2)] == (
        "https://shop.example/gp/bestsellers/toys/ref=zg_bs_pg_2_toys?ie=UTF8&pg=2")
    assert got[("https://shop.example", 1)] == (
        "https://shop.example/gp/bestsellers/ref=zg_bs_pg_1_kitchen?ie=UTF8&pg=1")


def test_set_query_param(spark):
    got = values(spark, ["https://a.example/p?TAG=1&x=&y=2", "ftp://a.example/"],
                 lambda v: U.with_query_param(v, "tag", "t-21"))
    assert got == ["https://a.example/p?x=&y=2&tag=t-21", None]


def test_media_url_cleanup(spark):
    df = spark.createDataFrame(
        [(["https:\\/\\/m.example\\/v.mp4?x=1\\u0026a=1)", "&quot;http://a/b.mp4&quot;", "/x.mp4", "http&colon;//q/&lpar;"],)],
        "urls array<string>")
    assert OU.clean_media_urls(df, "urls").first().media_urls == [
        "https://m.example/v.mp4?x=1&a=1", "http://a/b.mp4", "", "http://q/("]


# ---- pages ------------------------------------------------------------------------
def pages_of(spark, *htmls, url="https://shop.example/gp/bestsellers/kitchen"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)],
                                 "page_id long, url string, html string")


def test_clean_html_decodes_all_entities(spark):
    df = pages_of(spark, "<p>a&nbsp;&copy;&#233;&amp;lt;<script>x</script><b>‎b</b></p>", "plain & simple")
    got = [r.clean_text for r in P.clean_html(df).orderBy("page_id").collect()]
    assert got == ["a ©é&lt; b", "plain & simple"]


def test_fields_from_default_markup(spark):
    df = pages_of(
        spark,
        "<span id='productTitle'> Pan &amp; lid </span><div id=\"feature-bullets\"><ul><li> A </li>"
        "<li>Make sure this fits x</li><li>B</li><li> A </li></ul>",
        "<title>Pot : Amazon.in: Home</title><meta name='description' content='Good &amp; big'>",
    )
    got = P.extract_fields(df).orderBy("page_id").collect()
    assert [(r.title, r.description) for r in got] == [("Pan & lid", "A | B"), ("Pot", "Good & big")]


def test_presence_rules(spark):
    df = pages_of(
        spark,
        '<div id="altImages"><i class="videoThumbnail"></i><i class="videoThumbnail"></i></div>',
        '<div id="altImages"><span id="videoCount" class="x"> 3 VIDEOS</span></div>',
        '{"videoURL":"https:\\/\\/m.example\\/a.m3u8"} https://m.example/b.mp4?x=1&amp;y=2"',
        "nothing",
    )
    got = P.page_results(df).orderBy("page_id").collect()
    assert [(r.has_video, r.video_count, r.signals) for r in got] == [
        (True, 2, ["videoThumbnail-class"]),
        (True, 3, ["videoCount-label"]),
        (True, 2, ["media-url-in-page"]),
        (False, 0, []),
    ]
    assert got[2].video_urls == ["https://m.example/a.m3u8", "https://m.example/b.mp4?x=1&y=2"]
    assert got[2].planned_files == ["unknown_video_01.mp4", "unknown_video_02.mp4"]
    assert (got[2].downloaded_videos, got[2].download_errors) == ([], [])


def test_media_outside_the_block_sets_the_flag(spark):
    far = "x" * 300_100
    df = pages_of(spark, f'<div id="altImages">{far} http://m.example/a.mp4"')
    r = P.page_results(df, PageProfile(presence_block=300_000)).first()
    assert (r.has_video, r.video_count, r.signals) == (True, 1, [])
    assert P.page_results(df).first().signals == ["media-url-in-page"]


def test_numeric_entities_in_media_and_links(spark):
    df = pages_of(spark, '<video src="https://m.example/v.mp4?x=1&#38;y=2"><li><a href="/gp/bestsellers/x&#47;7">n</a></li>')
    r = P.page_results(df).first()
    assert (r.video_urls, r.video_count) == (["https://m.example/v.mp4?x=1&y=2"], 1)
    link = P.page_links(df, LinkProfile(), UrlProfile(), in_scope_only=False).first()
    assert link.branch_url.endswith("/gp/bestsellers/x/7")


def test_outcomes_of_fetching_and_downloading(spark):
    base = pages_of(spark, 'http://m.example/a.mp4 http://m.example/b.mp4', "captcha", "http://m.example/c.mp4 ")
    base = base.withColumn("url", F.concat("url", F.lit("?p="), F.col("page_id")))
    pages = base.withColumn("why", F.when(F.col("page_id") == 2, F.lit(" timeout "))).withColumn("error", F.lit("old"))
    url = [r.url for r in base.orderBy("page_id").collect()]
    done = spark.createDataFrame(
        [(url[0], "http://m.example/b.mp4", "b", ""), (url[0], "http://m.example/a.mp4", "a", None), (url[0], "http://m.example/z.mp4", None, "404 ")],
        "url string, video_url string, path string, error string",
    )
    results = P.page_results(pages, fetch_error=F.col("why"), downloads=done)
    got = {r.page_id: r for r in results.collect()}
    assert got[0].downloaded_videos == ["a", "b"]
    assert [(e.video_url, e.error) for e in got[0].download_errors] == [("http://m.example/z.mp4", "404")]
    assert (got[1].blocked, got[2].blocked, got[2].error, got[2].video_urls) == (True, False, "timeout", [])
    s = A.summarize(results).first()
    assert (s.page_errors, s.downloaded_products, s.downloaded_videos, s.download_errors) == (2, 1, 2, 1)


def test_blocked_page_counts_as_error(spark):
    results = P.page_results(pages_of(spark, "<title>x</title> CAPTCHA http://m.example/a.mp4 "))
    row = results.first()
    assert (row.blocked, row.title, row.has_video, row.video_urls) == (True, "", False, [])
    s = A.summarize(results).first()
    assert (s.total, s.with_video, s.without_video, s.blocked, s.page_errors) == (1, 0, 1, 1, 1)


def test_links_depth_and_up_flag(spark):
    html = (
        '<ul class="zg-browse-root zg-browse"><li class="zg-browse-up"><a href="/gp/bestsellers">Any</a>'
        '<a href="/gp/bestsellers/kitchen/ref=1">Up</a></li>'
        '<ul class="plain"><ul class="zg-browse"><li><a href="/gp/bestsellers/kitchen/12"> Pots\n &amp;  pans </a></li></ul>'
        '<li><a href="/gp/bestsellers/kitchen/13?x=1">Mid</a></li></ul></ul>'
        '<a href="/gp/bestsellers/kitchen/12/">again</a><a href="/other">no</a>'
    )
    got = P.extract_links(pages_of(spark, html), LinkProfile(), SITE).orderBy("pos").collect()
    assert [(r.branch_name, r.branch_url.rsplit("/", 1)[1], r.depth, r.is_up_link, r.cluster_key) for r in got] == [
        ("Up", "kitchen", 0, True, "kitchen"),
        ("Pots & pans", "12", 1, False, "12"),
        ("Mid", "13", 0, False, "13"),
    ]


def test_item_ids_from_three_places(spark):
    html = (
        '<a class="a-link-normal x" href="/n/dp/b07wms7twb/ref=1">a</a><a class="other" href="/dp/XXXXXXXXXX">b</a>'
        '<div data-asin="ZZZZZZZZZZ"></div><div data-asin="bad"></div>'
        '<div data-client-recs-list="[{&quot;id&quot;:&quot;aaaaaaaaaa&quot;},{&quot;x&quot;:1}]"></div>'
        "<div data-client-recs-list='{\"id\":\"CCCCCCCCCC\", broken'></div>"
    )
    got = P.extract_item_ids(pages_of(spark, html)).orderBy("pos").collect()
    assert [r.item_url[-10:] for r in got] == ["B07WMS7TWB", "AAAAAAAAAA", "CCCCCCCCCC", "ZZZZZZZZZZ"]


def test_next_pages(spark):
    item = '<a class="a-link-normal" href="/dp/B07WMS7TWB">x</a>'
    nav = '<ul class="a-pagination">{}</ul>'
    base = "https://shop.example/gp/bestsellers/s{}"
    htmls = [
        nav.format('<li class="a-last"><a href="/gp/bestsellers/s0?pg=2">n</a></li>'),
        nav.format('<li><a href="/gp/bestsellers/s1?pg=1">1</a></li><li><a href="/gp/bestsellers/s1?pg=2">2</a></li>'
                   '<li><a href="/gp/bestsellers/s1?pg=3">3</a></li>'),
        nav.format('<li class="a-disabled a-last">n</li>') + item,
        item,
        "no items",
    ]
    df = spark.createDataFrame([(i, base.format(i), h) for i, h in enumerate(htmls)],
                               "page_id long, url string, html string")
    planned = spark.createDataFrame([(base.format(1), 2)], "branch_url string, page_no long")
    got = P.next_page_edges(df, scheduled=planned).orderBy("page_id", "page_no").collect()
    assert [(r.page_id, r.page_no, r.via) for r in got] == [
        (0, 2, "next"), (1, 3, "number"), (3, 2, "onward")]
    assert P.next_page_edges(df, max_pages=1).count() == 0


# ---- queues -------------------------------------------------------------------------
def test_dedupe_first_and_counts(spark):
    df = spark.createDataFrame([(0, "https://a/x#1"), (1, "https://b/y"), (2, "https://a/x?z"), (3, "  ")],
                               "ord int, url string")
    key = F.when(F.trim("url") != "", U.canonical_section("url"))
    got = Q.dedupe_first(df, F.coalesce(key, F.lit("")), ["ord"]).orderBy("ord").collect()
    assert [(r.ord, r.key) for r in got] == [(0, "https://a/x"), (1, "https://b/y")]
    k = Q.kept_counts(df.limit(3), U.canonical_section("url")).first()
    assert (k.original, k.kept, k.removed) == (3, 2, 1)


def test_lookup_slug(spark):
    df = spark.createDataFrame([(" Home  &  Kitchen ",), ("my-slug",), ("Pots & Pans!",), ("!!",)], "name string")
    got = {r.name.strip(): (r.slug, r.known) for r in Q.lookup_slug(df, "name").collect()}
    assert got == {
        "Home  &  Kitchen": ("kitchen", True), "my-slug": ("my-slug", False),
        "Pots & Pans!": ("pots-and-pans", False), "!!": ("kitchen", False),
    }


def test_next_slot(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-01 11:30:00'), (TIMESTAMP_NTZ'2024-01-01 19:45:00'),"
                   "(TIMESTAMP_NTZ'2024-01-01 11:29:59.9') AS t(ts)")
    got = [str(r.next_slot) for r in Q.next_slot(df, "ts").collect()]
    assert got == ["2024-01-01 17:30:00", "2024-01-02 11:30:00", "2024-01-01 11:30:00"]


def test_bad_slots_are_refused():
    with pytest.raises(ValueError):
        Q.slot_minutes(["25:00"])
    with pytest.raises(ValueError):
        Q.slot_minutes([])


def test_recover_skipped(spark):
    skipped = spark.createDataFrame([("p1", "A"), ("p3", "B"), ("p9", "C"), ("p0", "")], "url string, item_key string")
    ready = spark.createDataFrame([("B",), ("C",)], "item_key string")
    queue = spark.createDataFrame([("p1", 1), ("p3", 3)], "url string, pos long")
    cursor = spark.createDataFrame([(5,)], "cursor long")
    rec, rest, cur = Q.recover_skipped(skipped, ready, queue, cursor)
    assert {r.url for r in rec.collect()} == {"p3", "p9"}
    assert {r.url for r in rest.collect()} == {"p1", "p0"}
    assert cur.first().cursor == 3


def test_latest_with_any_key_fallback(spark):
    df = spark.createDataFrame([("a", "p1", 1, True), ("a", "p2", 2, True), ("b", "p3", 3, False)],
                               "key string, path string, mtime int, old boolean")
    assert {r.path for r in Q.latest_per_key(df, seen=F.col("old")).collect()} == {"p2", "p3"}
    assert Q.latest_per_key(df, any_key="zz").first().path == "p3"
    assert Q.latest_per_key(df, any_key="a").first().path == "p2"


def test_error_map(spark):
    df = spark.createDataFrame([("g", "u1", "x"), ("g", "u2", "y")], "g string, url string, error string")
    assert Q.error_map(df, ["g"], "url").first().errors == {"u1": "x", "u2": "y"}


def test_stub_fallback(spark):
    keys = spark.createDataFrame([(" a ",), ("z",)], "k string")
    rows = spark.createDataFrame([("A", "first", 1), ("a", "second", 2)], "k string, v string, o int")
    got = {r.k: r.v for r in Q.lookup_with_fallback(keys, rows, "k", ["o"], ["v"], "stub").collect()}
    assert got == {" a ": "first", "z": ""}


# ---- sequences -----------------------------------------------------------------------
def test_interleave(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["A", "A", "A", "B", "C", "C"])], "ord long, c string")
    got = S.interleave(df, "c", "ord", 2).collect()
    assert [(r.c, r.round_no) for r in got] == [("A", 1), ("B", 1), ("C", 1), ("A", 2), ("C", 2), ("A", 3)]


def test_rates_and_ewma(spark):
    df = spark.sql("SELECT * FROM VALUES ('s', TIMESTAMP'2024-01-01 00:00:00', 0, 0, 0.5D),"
                   "('s', TIMESTAMP'2024-01-01 00:00:04', 8, 2, 0.9D), ('s', TIMESTAMP'2024-01-01 00:00:08', 8, 2, 0.9D)"
                   " AS t(source, ts, responses, errors, x)")
    got = S.counter_rates(df, "source", ["ts"], slice_seconds=4).orderBy("ts").collect()
    assert (got[0].rps, got[1].rps, got[1].error_rate, got[2].rps) == (None, 2.0, 0.2, 0.0)
    s = S.ewma(df, "source", ["ts"], "x", slice_seconds=4).orderBy("ts").collect()
    assert [round(r.smoothed, 6) for r in s] == [0.175, 0.42875, 0.593687]


def test_allocate_weighted(spark):
    df = spark.createDataFrame([(1, 0, "one two three four"), (1, 1, " "), (1, 2, " ".join("abcdefghij"))],
                               "k int, o long, line_text string")
    got = S.allocate_weighted(df, "k", "o", ["line_text"], F.lit(10.0), 1.2).orderBy("scene_index").collect()
    assert [(r.start_sec, r.end_sec, r.duration_sec) for r in got] == [(0.0, 3.371, 3.371), (3.371, 10.0, 6.629)]


def test_lone_line_gets_a_close(spark):
    df = spark.createDataFrame([(1, 0, "only one")], "k int, o long, t string")
    assert S.split_even(df, "k", "o", "t", F.lit(6.0), 3).count() == 2
    assert S.split_even(df, "k", "o", "t", F.lit(5.0), 3).count() == 1


def test_segments_end_at_the_total(spark):
    rows = [(k, o, "w " * (o % 7 + 1)) for k in (1, 2) for o in range(40)]
    df = spark.createDataFrame(rows, "k int, o long, t string")
    alloc = S.allocate_weighted(df, "k", "o", ["t"], F.lit(33.3), 1.2, chunk_width=4)
    packed = S.compress_groups(alloc, "k", 5, F.lit(33.3))
    for out, n in ((alloc, 40), (packed, 5)):
        per = out.groupBy("k").agg(F.max("end_sec").alias("e"), F.count(F.lit(1)).alias("n")).collect()
        assert {(r.e, r.n) for r in per} == {(33.3, n)}


# ---- text ----------------------------------------------------------------------------
def test_cut_noise(spark):
    got = values(spark, ["window.$Nav rest", "good  text window.$Nav rest", "x" * 2300], X.cut_noise)
    assert got == ["window.$Nav rest", "good text", "x" * 2200 + "..."]


def test_suffix_title(spark):
    got = values(spark, ["Pan (Malayalam)", "", "a" * 86 + " - long tail of words"], X.suffix_title)
    assert got[:2] == ["Pan (MALAYALAM)", "Product Review (MALAYALAM)"]
    assert got[2] == "a" * 86 + " (MALAYALAM)"
    assert values(spark, got, X.suffix_title) == got  # once is enough


def test_word_budget(spark):
    df = spark.createDataFrame([(float(s),) for s in (3, 30, 50, 90, 130)], "s double").withColumn("t", F.lit("a b"))
    got = O.word_budget(df, "t", F.col("s")).orderBy("s").collect()
    assert [(r.words_min, r.words_max, r.words_hint) for r in got] == [
        (87, 105, 95), (87, 105, 95), (113, 133, 123), (203, 239, 221), (258, 302, 280)]


def test_json_from_text(spark):
    got = values(spark, [
        'ok {"a":"}"} tail', '{"a":1}', "```json\n{\"b\": [1]}\n```", "[1]", 'x {"q":"\\""} y', "{bad} {\"a\":1}", "",
    ], X.json_text)
    assert got == ['{"a":"}"}', '{"a":1}', '{"b": [1]}', None, '{"q":"\\""}', None, None]


def test_error_kinds_and_retry(spark):
    got = values(spark, ["HTTP 503 from host", "RESOURCE_EXHAUSTED", "fine"], X.error_kinds)
    assert [(k.rate_limit, k.transient) for k in got] == [(False, True), (True, False), (False, False)]
    df = spark.createDataFrame([("QUOTA retry in 7.5s",), ("QUOTA retry in 30s",), ("timeout",), ("fine",)], "m string")
    got = O.retry_decision(df, "m", F.lit(1), 4).collect()
    assert [(r.decision, r.wait_seconds) for r in got] == [
        ("wait", 7.5), ("raise", None), ("wait", 3.0), ("raise", None)]


def test_mask_and_tokens(spark):
    assert values(spark, ["abcdefgh", "abcdefghij", ""], X.mask) == ["********", "abcd...ghij", "*"]
    assert values(spark, ["a, b;a  c"], X.tokens) == [["a", "b", "c"]]


def test_closing_and_opening(spark):
    df = spark.createDataFrame([(0, "Good pan. Link in bio now. Fine"), (1, "Stop scrolling and see. x"), (2, "")],
                               "i int, t string")
    got = [r.text_out for r in O.ensure_lines(df, "t", "See this pan", "Buy it").orderBy("i").collect()]
    assert got == [
        "See this pan. Good pan. Fine. Buy it", "Stop scrolling and see. x. Buy it", "See this pan. Buy it"]
    similar = spark.createDataFrame([(0, "See this pam now. x")], "i int, t string")
    kept = O.ensure_lines(similar, "t", "See thas pam now", "").first().text_out
    assert kept == "See this pam now. x"


def test_segment_lines(spark):
    df = spark.createDataFrame([(1, 0, "aa bb"), (1, 1, "cc"), (1, 2, "dd")], "k int, o int, t string")
    got = O.ensure_lines_in_segments(df, "k", "o", "t", "Look here", "Buy").orderBy("o").collect()
    assert [r.t for r in got] == ["Look here. aa bb", "cc", "dd. Buy"]


def test_keywords(spark):
    df = spark.createDataFrame([("Steel Pan, Best", "It is new; a+b c. PAN steel pan")], "t string, d string")
    got = O.derive_keywords(df, F.col("t"), F.col("d")).first().keywords
    assert got == ["Steel Pan", "Best It is new", "a+b c", "PAN steel pan", "Steel", "Pan", "a+b"]


def test_lrm_and_unicode_blank(spark):
    assert values(spark, ["a‎  b&nbsp;c"], H.clean_text) == ["a b c"]


def test_links_of_untidy_lists(spark):
    """Unclosed anchors do not swallow list tags; closing tags without opening ones count for nothing."""
    df = pages_of(
        spark,
        '</ul></li><ul class="zg-browse"><li class="zg-browse-up"><a href="/gp/bestsellers/a/1">up'
        '<li><ul class="zg-browse"><li><a href="/gp/bestsellers/b/2"> in </a></li></ul></li></li></ul>'
        '<ul><li><a href="/gp/bestsellers/c/3">out</a></li></ul>',
    )
    got = P.page_links(df, LinkProfile(), UrlProfile(), in_scope_only=False).orderBy("pos").collect()
    assert [(r.branch_url[-3:], r.branch_name, r.depth, r.is_up_link) for r in got] == [
        ("a/1", "", 0, True), ("b/2", "in", 1, False), ("c/3", "out", 0, False),
    ]


UP, IN = '<li class="zg-browse-up">', '<ul class="zg-browse">'


@pytest.mark.parametrize(("html", "want"), [
    # The next item ends the one before, in the same list only.
    (f"{IN}{UP}<a>1</a><li><a>2</a></ul><a>3</a>", [(0, True), (0, False), (0, False)]),
    (f"{IN}{UP}<a>1</a>{IN}<li><a>2</a><li><a>3</a></ul><a>4</a><li><a>5</a></ul>", [(0, True), (1, True), (1, True), (0, True), (0, False)]),
    # The end of a list ends its open items; the end of an item does not reach out of its list.
    (f"{IN}{UP}{IN}</li><a>1</a></ul><a>2</a></li><a>3</a></ul><a>4</a>", [(1, True), (0, True), (0, False), (0, False)]),
    (f"{IN}{UP}<ol><li><a>1</a></ul><a>2</a>", [(0, True), (0, False)]),
    (f"{IN}<ol>{UP}<a>1</a><li><a>2</a></ol><a>3</a></ul></ul></li><a>4</a>", [(0, True), (0, False), (0, False), (0, False)]),
    (f"{IN}{IN}{IN}<li><a>1</a>", [(2, False)]),
])
def test_implied_end_tags(spark, html, want):
    for i in range(1, 10):
        html = html.replace(f"<a>{i}<", f'<a href="/gp/bestsellers/x/{i}">{i}<')
    got = P.page_links(pages_of(spark, html), LinkProfile(), UrlProfile(), in_scope_only=False).orderBy("pos").collect()
    assert [(r.depth, r.is_up_link) for r in got] == want


def test_many_links_of_one_page(spark):
    """More links than fit one run, in page order; four times the links take about four times as long."""
    import time

    def seconds(n):
        df = pages_of(spark, IN + "".join(f'<li><a href="/gp/bestsellers/x/{i}">{i}</a>' for i in range(n))).cache()
        df.count()
        start = time.perf_counter()
        got = P.page_links(df, LinkProfile(), UrlProfile(), in_scope_only=False).select("branch_name", "depth").collect()
        took = time.perf_counter() - start
        assert [(r.branch_name, r.depth) for r in got] == [(str(i), 0) for i in range(n)]
        return took

    seconds(100)
    assert seconds(12_000) < 10 * seconds(3_000) + 1


def test_only_references_leave_for_the_decoder(spark):
    """Texts equal Python's own decoding; what the Arrow function gets is references, not bodies."""
    import html

    from shelfspark.functions import html as H

    texts = [
        None, "", "plain", "&amp;", "&amp;lt;", "&eacute;&eacute", "a &euro; b &#8364; c &#x20AC", "&notit; &notin;", "&&amp;amp;&#0;&#x80;",
        "end &nbsp;", "&nbsp; start", "a=1&b=2&copy=3", "&" + "x" * 40 + ";", "&lt;b&gt; &Auml;\n&\t&#;", "\U0001f600&\U0001f600\U0001f600;&ouml;", "&#xD800;|&#99999999;|&hellip",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", H.unescape(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}
    found = spark.createDataFrame([(["&amp;", "&nbsp;"],), ([],), (None,)], "r array<string>").select(H._decode_entities("r").alias("d"))
    assert [r.d for r in found.collect()] == [["&", "\u00a0"], [], None]


def test_keywords_are_found_without_sorting_all_words(spark):
    """The first words, each in its first spelling; only as many are looked at again as are wanted."""
    r = random.Random(11)
    words = ["Steel", "steel", "STEEL", "pan", "Pans", "the", "Best", "a-b", "C++", "Kelvin", "kelvin", "x1", "Buy", *(f"w{i}" for i in range(40))]
    texts = [None, "", "the best", *("".join(r.choice(words) + r.choice([" ", " ", "  ", ", ", ".\n", " | "]) for _ in range(r.randrange(1, 120))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("k", X.keywords(F.lit("Steel Pan, The Best"), F.col("t")))
    for row in df.collect():
        text = "Steel Pan, The Best " + (row.t or "")
        found = [" ".join(c.split()) for c in re.split(r"[,\n\r|.;:()\-]+", text)]
        found = [c for c in found if re.search("[A-Za-z]", c) and len(c) <= 42 and 2 <= len(c.split(" ")) <= 5]
        found = [re.sub(r"[^A-Za-z0-9 #&+\-]+", "", w).strip(" ") for w in found + re.findall(r"[A-Za-z][A-Za-z0-9+\-]{2,}", text)]
        firsts = {}
        for w in found:
            if len(w) > 2 and w.lower() not in STOPWORDS:
                firsts.setdefault(w.lower(), w)
        assert row.k == list(firsts.values())[:12], row
    assert "array_sort" not in df._jdf.queryExecution().optimizedPlan().toString()
