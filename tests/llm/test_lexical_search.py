"""Ranked search against plain scores of every document."""

import math
import random
import re
from collections import Counter

from shelfspark.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        ranked = []
        for d, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                ranked.append((-score, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(ranked, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def frame(spark, rows, key):
    made = spark.createDataFrame([(*r, "clash", 0, 0) for r in rows], f"{key} long, text string, term string, m int, rank int")
    return made.repartition(3)


def got(spark, docs, items, k=10, cell=4096, size=4 << 20, **more):
    index = lexical_search.build(frame(spark, docs, "doc_id"), cell, size)
    out = lexical_search.search(index, frame(spark, items, "item_id"), k, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(n=300, words=60):
    r = random.Random(3)
    pool = [f"w{i}" for i in range(words)] + ["Ärger", "ÀB", "naïve", "日本", "x1"]
    text = lambda size: r.choice([" ", ", ", "-\n"]).join(r.choice(pool[: r.randrange(5, len(pool))]) for _ in range(size))
    docs = [(i, text(r.choice([1, 3, 10, 40, 200]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [(5, docs[5][1]), (5, "other w1"), (None, "w1 w2"), (None, "w1 w2"), (-3, None), (-4, ""), (-5, " .,;")]
    items = [(i, text(r.choice([1, 5, 12]))) for i in range(20)] + [(90, "W1 w1 w2"), (90, "w3"), (91, None), (92, ""), (93, "never seen"), (None, "w1"), (94, "日本 ÄRGER ärger Ärger")]
    return docs, items


def test_all_scores(spark):
    docs, items = corpus()
    assert got(spark, docs, items) == plain(docs, items)


def test_small_cells_waves_and_blocks(spark):
    docs, items = corpus()
    assert got(spark, docs, items, k=4, cell=7, size=900, first=20, group=3) == plain(docs, items, 4)


def test_a_wave_of_one_stratum_leaves_ties_whole(spark):
    docs = [(i, "a b" if i % 2 else "b a") for i in range(50)] + [(100 + i, "a " * (i + 2)) for i in range(9)]
    items = [(1, "a b"), (2, "a"), (3, "b")]
    for first in (1, 10, 1000):
        assert got(spark, docs, items, k=10, cell=3, first=first) == plain(docs, items, 10)


def test_very_long_texts(spark):
    docs = [(1, "alpha " * 50_000 + "omega"), (2, "omega"), (3, "b" * 200_000), (4, "alpha")]
    items = [(1, "omega alpha " * 20_000), (2, "b" * 200_000)]
    assert got(spark, docs, items) == plain(docs, items)


def test_without_rows(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []
