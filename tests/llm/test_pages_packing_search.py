"""URL rules, fixity audit, packing, decontamination and search against plain versions."""

import os
import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm import decontamination, packing, registry, topk_search, url_filters, warc_audit

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PAGE = "page_id long, url string, html string, host string, rule string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGE)


def as_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    kinds = {"**": b"(?s:.*)", "*": b"[^/]*", "?": b"[^/]"}
    return re.compile(b"".join(kinds.get(p, re.escape(p.encode())) for p in parts))


def test_automaton_matches_regular_expressions():
    r = random.Random(2)
    letters = "ab/.*?"
    globs = ["**", "", "*", "a**b", "*.org/**", "?" * 70 + "**"] + ["".join(r.choice(letters) for _ in range(r.randrange(1, 12))) for _ in range(60)]
    urls = [b"", b"a" * 100, "ä/a".encode()] + ["".join(r.choice("ab/.") for _ in range(r.randrange(0, 90))).encode() for _ in range(200)]
    got = url_filters.Automaton(globs).fits(urls)
    for j, glob in enumerate(globs):
        pattern = as_regex(glob)
        for i, url in enumerate(urls):
            assert got[i, j] == (pattern.fullmatch(url) is not None), (glob, url)


def test_url_rules(spark):
    rules = [url_filters.Rule(*x) for x in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "a.b", "/"), ("allow", "b", "/xx"))]
    rows = [
        (1, "http://EXAMPLE.org/es/1?q#f", None), (2, "http://x.example.org/fr", None), (3, "http://notorg/es/", None), (4, None, None), (None, "no scheme", None),
        (5, "http://q.com/a.org/es/", None), (6, "://org", None), (7, "a://b://org/", None), (8, "http://a.b/xx", None), (8, "http://a.b/xx", None),
        (9, "http://ex.org/" + "y" * 100_000, None), (10, "http://Ä.org/ß", None), (11, "ftp://ads.com/banner", None), (12, "http://org?x/", None),
    ]
    got = url_filters.filter_urls(pages_of(spark, rows), rules, ("**/banner*",)).collect()
    told = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in got}
    assert told[1] == ("example.org", "/es/1", "example.org/es/", "block") and told[2][2:] == ("org/", "allow")
    assert told[3][2:] == (None, "allow") and told[4] == ("", "", None, "allow") and told[None] == ("", "", None, "allow")
    assert told[5][2] is None and told[6] == ("org", "", None, "allow") and told[7] == ("b:", "//org/", None, "allow")
    assert told[8][2:] == ("a.b/", "block") and told[9][2] == "org/" and told[10][:3] == ("Ä.org", "/ß", "org/")
    assert told[11][2:] == (None, "block") and told[12] == ("org", "", None, "allow") and len(got) == len(rows)
    assert url_filters.filter_urls(pages_of(spark, []), rules).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_globs_judge_pages_without_a_rule(spark):
    got = registry.QUERIES["op5_url_filters"](spark, "/root/testdata/sf0.01").collect()
    blocked = [r for r in got if r.rule is None and r.verdict == "block"]
    assert blocked and all("casino-" in r.host or "-pills." in r.host or "spam-" in r.host or r.path.endswith(".exe") for r in blocked)
    assert any(r.rule is None and r.verdict == "allow" for r in got)


def fixity_rows():
    return [(i, f"http://h/{i}", f"<p>{i}</p>\r\n\r\n" * (i % 5)) for i in range(0, 9000, 3)] + [(5, None, None), (-4000, "u", "x"), (None, "n", "loose"), (7, "a", "b"), (7, "a", "c")]


def test_audit_finds_exactly_the_damage(spark):
    rows = fixity_rows()
    other = [r for r in rows if r[0] not in (300, 8997)]
    other = [(i, u, "damaged" if i in (6, 4098, -4000) else h) for i, u, h in other]
    other = [(i, u, "c!" if (i, h) == (7, "c") else "lost" if h == "loose" else h) for i, u, h in other] + [(100_000, "new", "new")]
    got = warc_audit.audit(pages_of(spark, rows), pages_of(spark, other).repartition(5)).collect()
    assert sorted((str(r.page_id), r.kind) for r in got) == sorted(
        [("300", "missing"), ("8997", "missing"), ("6", "changed"), ("4098", "changed"), ("-4000", "changed"), ("7", "changed"), ("100000", "extra"), ("None", "missing"), ("None", "extra")]
    )
    assert warc_audit.audit(pages_of(spark, rows), pages_of(spark, rows[::-1])).count() == 0
    assert warc_audit.audit(pages_of(spark, []), pages_of(spark, rows[:2])).count() == 2


def test_offsets_follow_the_records(spark):
    rows = pages_of(spark, fixity_rows()[:50])
    got = warc_audit.slots(rows).orderBy("slot").collect()
    size = {r.page_id: r.n + 4 for r in rows.select("page_id", F.octet_length(warc_audit.record(rows)).alias("n")).collect()}
    at = 0
    for r in got:
        assert (r.offset, r.length) == (at, size[r.slot])
        at += r.length


def test_warc_files_round_trip(spark, tmp_path):
    rows = pages_of(spark, [r for r in fixity_rows() if r[1] is not None])
    warc_audit.write_warc(rows, str(tmp_path / "warc"))
    back = warc_audit.read_warc(spark, str(tmp_path / "warc"))
    assert back.where("not intact").count() == 0 and warc_audit.audit(rows, back).count() == 0


def test_plan_uses_every_piece_once_and_fills_well():
    r = np.random.default_rng(3)
    for counts in ({2048: 5, 1000: 3, 48: 1}, {1: 5000}, {1: 10**12, 2047: 10**11}, dict.fromkeys(range(1, 2049), 3), {}, {700: 7, 648: 7}, dict(enumerate(r.integers(0, 50, 300).tolist(), 1))):
        counts = {k: v for k, v in counts.items() if v}
        patterns = packing.plan(counts)
        used = defaultdict(int)
        for pattern, n in patterns:
            assert n > 0 and sum(k * m for k, m in pattern.items()) <= 2048
            for k, m in pattern.items():
                used[k] += n * m
        total = sum(k * v for k, v in counts.items())
        assert dict(used) == counts and sum(n for _, n in patterns) <= -(-total // 2048) * 1.35 + 2


def test_pieces_match_the_tokenizer(spark):
    texts = [None, "", " ", "Hello, World! it's 12 o'clock", "ÉCOLE İstanbul ẖ H\u0331 ﬁ", "a\u00a0b\x1cc\u2003d", "<|endoftext|> x <|STARTOFTEXT|>y<|startoftext|>", "word " * 5000, "Σας ΣΑΣ 日本語", "can't WON'T, we're.", "a.\u0301 \u0301b", "caf\u2014'. b\u0301. a\u0301! x\u2019s. \u00a0... naïve,%%% it's' <|endoftext|>."]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, "no id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(df, TOKENIZER, capacity=64, with_ids=True).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    want = defaultdict(list)
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want[i, n].append((a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), part))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32, list(r.ids)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for held in rooms.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= 64
    assert packing.pack(df.where("false"), TOKENIZER).count() == 0


def test_sums_of_one_two_and_three_lengths():
    r = random.Random(4)
    for capacity in (1, 2, 9, 40):
        left = np.zeros(capacity + 1, dtype=np.int64)
        for _ in range(capacity // 2 + 1):
            left[r.randrange(1, capacity + 1)] = r.randrange(1, 4)
        sums, there = packing.Sums(left), np.flatnonzero(left).tolist()
        for gone in (None, there[0]):
            if gone is not None:
                left[gone] = 0
            there = np.flatnonzero(left).tolist()
            for total in range(capacity + 1):
                pairs = {a for a in there for b in there if b <= a and a + b == total}
                assert sums.single(total) == (total in there) and sums.pairs(total).tolist() == sorted(pairs, reverse=True)
                triples = {a for a in there for b in there for c in there if a + b + c == total}
                assert triples <= set(sums.triples(total).tolist()) <= set(there)


def test_exact_complements_come_before_best_fit():
    made = packing.plan({6: 2, 4: 1, 3: 1, 1: 1, 5: 3, 2: 1}, 10)
    assert ({6: 1, 4: 1}, 1) in made and ({6: 1, 3: 1, 1: 1}, 1) in made and ({5: 2}, 1) in made
    assert sum(n for _, n in made) == 4


def test_word_table_starts_anew_when_full():
    words = packing.Words(TOKENIZER, limit=10)
    tok = words.tokenizer
    for text in ("one two three, four five six seven!", "eight nine ten eleven twelve", "one two three"):
        for _ in range(2):
            assert words.encode(text.encode().split())[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_word_table_learns_halves_once():
    words = packing.Words(TOKENIZER)
    held = [b"one", b"one,", b"one...", b"two,", b"two", b"it's", b"...", "caf\u00e9,".encode()]
    for _ in range(2):
        assert words.encode(held)[0].tolist() == words.tokenizer.encode(b" ".join(held).decode(), add_special_tokens=False).ids
    assert set(words.known) == {b"", b"one", b"two", b"it's", b",", b"...", "caf\u00e9".encode()}


def test_full_word_table_keeps_words_met_again():
    words = packing.Words(TOKENIZER, limit=8)
    for text in ("one two three four", "two three five six seven eight", "nine"):
        assert words.encode(text.encode().split())[0].tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert set(words.known) == {b"", b"two", b"three", b"nine"}


def test_words_match_the_tokenizer_on_odd_texts():
    r = random.Random(6)
    parts = ["a", "The", "'s", "'ll", "\u00c9", "H\u0331", "\u0130", "\u03a3", "\u0301", "\u0338", "<", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "\u00bd", " ", " ", "\n", "\x1c", "\x85", "\u00a0", "\u2026", ",", "...", "\u65e5", "\x00", "\U0001f600"]
    words = packing.Words(TOKENIZER, limit=100)
    for _ in range(60):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(10)]
        held, counts = packing._words(pa.array(texts))
        ids, size = words.encode(held)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)]
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def benchmark_rows():
    r = random.Random(7)
    return [(i, " ".join(f"q{r.randrange(3000)}" for _ in range(n))) for i, n in enumerate([15, 20, 40, 59, 9, 30])] + [(50, None), (51, ""), (52, "too short item")]


def test_decontamination_tolerates_substitutions(spark, benchmark_rows):
    r = random.Random(8)
    noise = lambda n: [f"n{r.randrange(9000)}" for _ in range(n)]
    rows, want = [], set()
    for d in range(120):
        item, text = benchmark_rows[d % 4]
        words = text.split()
        for at in r.sample(range(len(words)), len(words) // 6 if d % 2 else 0):
            words[at] = "changed"
        rows.append((d, " ".join([*noise(50), *(w.upper() + "," for w in words), *noise(20)])))
        want.add((d, item))
    rows += [(500 + d, " ".join(noise(200))) for d in range(50)] + [(900, None), (901, ""), (None, benchmark_rows[2][1]), (902, benchmark_rows[2][1][:60]), (903, " ".join(noise(60000)) + " " + benchmark_rows[3][1])]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id long, text string, item_id string, lines string")
    items = spark.createDataFrame([(*b, "clash") for b in [*benchmark_rows, benchmark_rows[0]]], "item_id long, text string, doc_id string")
    got = decontamination.contaminated(docs, items).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want | {(None, 2), (903, 3)} | ({(902, 2)} if len(benchmark_rows[2][1][:60].split()) > 12 else set())
    assert len(got) == len({(x.doc_id, x.item_id) for x in got}) and all(x.similarity >= 0.8 for x in got)
    kept = {x.doc_id for x in decontamination.keep_uncontaminated(docs, items).collect()}
    assert kept == {x[0] for x in rows} - {x.doc_id for x in got}
    assert decontamination.contaminated(docs.where("false"), items).count() == 0 == decontamination.contaminated(docs, items.where("false")).count()


@pytest.mark.parametrize("size", range(1, 30))
def test_masks_find_all_substitutions_of_a_fifth(size):
    """From 30 tokens on, a stretch splits into ones of 15 and of 15 to 29 tokens, one of which is no worse."""
    masks = decontamination.masks_of(size, 0.8)
    windows = [sum(1 << (a + i) for i, c in enumerate(m) if c == "1") for m in masks for a in range(size - len(m) + 1)]
    for gone in combinations(range(size), size // 5):
        bits = sum(1 << i for i in gone)
        assert any(not w & bits for w in windows), gone


def longest_alike(item, text):
    """Over all shifts: is there a stretch of 12 tokens, or the whole item, equal in 0.8 of its places?"""
    least = min(12, len(item))
    for shift in range(-len(item) + 1, len(text)):
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        same = [item[i] == text[i + shift] for i in range(lo, hi)]
        for x in range(len(same)):
            for y in range(x + least, len(same) + 1):
                if 10 * sum(same[x:y]) >= 8 * (y - x):
                    return True
    return False


def test_decontamination_matches_brute_force(spark):
    """Few different tokens, items of 1 to 24 tokens, any number of them changed."""
    r = random.Random(11)
    word = lambda: f"t{r.randrange(60)}"
    items = [(i, [word() for _ in range(1 + i)]) for i in range(24)] + [(30 + i, [word() for _ in range(r.randrange(4, 13))]) for i in range(20)]
    docs = []
    for d in range(150):
        own = list(items[d % len(items)][1])
        for at in r.sample(range(len(own)), r.randrange(0, len(own) // 4 + 2) % (len(own) + 1)):
            own[at] = "other"
        docs.append((d, [word() for _ in range(r.randrange(0, 15))] + own + [word() for _ in range(r.randrange(0, 15))]))
    want = {(d, i) for d, text in docs for i, item in items if longest_alike(item, text)}
    made = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, ", ".join(t)) for i, t in items], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.contaminated(made, asked).collect()} == want
    assert 150 < len(want) < 150 * 44


def test_search_matches_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(300)] + [(300 + i, [1.0, 0.5, 0.0, -1.0, 2.0, 0.25]) for i in range(60)]
    rows += [(None, [1.0] * 6), (1000, None), (1001, [1.0, None, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1005, []), (1020, [1.0, 2.0]), (1025, [2.0, 1.0]), (0, rows[0][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, dim int")
    good = {(i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:20]
            want += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    for sizes in ({}, {"block": 8, "shelf": 2, "group": 5}):
        got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, **sizes).collect()
        assert sorted(tuple(x) for x in got) == sorted(want)
    assert topk_search.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_shelves_out_of_reach_are_not_brought():
    """Of two shelves only that whose bound reaches the bar meets the group."""
    import pyarrow as pa

    blob = lambda rows: np.array(rows, dtype=np.int64).tobytes()
    row = lambda shelf, hi, lo, bar: {"group": 5, "shelf": shelf, "dim": 2, "qv": blob([[3, -2], [1, 1]]), "hi": blob(hi), "lo": blob(lo), "bar": blob(bar)}
    rows = [row(1, [[2, 9], [1, 1]], [[0, 1], [0, 0]], [5, 12]), row(2, [[2, 9]], [[0, 1]], [4, 99]), row(3, [[2, 9]], [[0, 1]], [5, 11])]
    batch = pa.RecordBatch.from_pylist(rows)
    assert [(r["group"], r["shelf"]) for b in topk_search._worth([batch]) for r in b.to_pylist()] == [(5, 2), (5, 3)]


def test_search_with_large_components_is_exact(spark):
    rows = [(i, [float(2**20 + i), float(-(2**21) - 3 * i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") == 0, k=50, block=8, shelf=2).collect()
    assert [(x.vec_id, x.score) for x in sorted(got, key=lambda x: x.rank)] == [(i, 4096 * (2**20 * (2**20 + i) + 2**21 * (2**21 + 3 * i))) for i in range(49, 0, -1)]
