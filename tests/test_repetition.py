"""The full repetition rule against a plain walk over small fixtures."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import repeats as R
from shelfspark.functions import text as X
from shelfspark.operators import text as O

PAIRS = [
    ("this pan heats fast and cleans easily", "this pan heats fast and cleans easy", True),
    ("it saves time", "it saves tome", True),
    ("buy the red one", "the red one buy", True),
    ("buy the red one", "sell my blue two", False),
    ("a b", "a c", False),
]


def expected(a, b):
    """The rule, word for word."""
    if not a or not b:
        return False
    wa, wb = a.split(), b.split()
    short, long_ = (wa, wb) if len(wa) <= len(wb) else (wb, wa)
    lead = 0
    while lead < len(short) and wa[lead] == wb[lead]:
        lead += 1
    share = len(set(wa) & set(wb)) / min(len(set(wa)), len(set(wb)))
    ratio = SequenceMatcher(None, a, b).ratio()
    return (
        a == b
        or (len(short) >= 4 and " ".join(long_).startswith(" ".join(short)) and len(short) / len(long_) >= 0.45)
        or (lead >= 4 and lead / len(short) >= 0.55)
        or (len(short) >= 3 and (ratio >= 0.9 or share >= 0.88 or (ratio >= 0.8 and share >= 0.68)))
    )


def test_ratio_equals_the_plain_one():
    """Random pairs over small and large alphabets, edited copies, and texts long enough to have common letters."""
    rng = random.Random(5)
    for n in range(10_000):
        letters = rng.choice(["ab", "abcde ", "etaoin shrdlu", "äöü日本語 ab"])
        size = rng.choice([0, 1, 5, 20, 60]) if n % 50 else rng.choice([200, 260, 500])
        a = "".join(rng.choice(letters) for _ in range(size))
        if n % 2:
            b = list(a)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randrange(3)] = rng.choice(letters) * rng.randrange(3)
            b = "".join(b)
        else:
            b = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 1 + 2 * size)))
        assert R.ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_rules_equal_the_plain_ones_for_any_pair():
    rng = random.Random(6)
    words = "the red pan heats fast and it saves time in my small kitchen".split()
    keys = {"a"}
    while len(keys) < 400:
        own = [rng.choice(words) for _ in range(rng.randrange(1, 10))]
        keys.add(" ".join(own))
        own[rng.randrange(len(own))] += rng.choice("sxyz")
        keys.add(" ".join(own))
    keys = sorted(keys)
    held = R.Keys(pa.array(keys))
    a, b = np.array([rng.randrange(len(keys)) for _ in range(20_000)]), np.array([rng.randrange(len(keys)) for _ in range(20_000)])
    got = held.repeats(a, b, True)
    assert got.tolist() == [expected(keys[x], keys[y]) for x, y in zip(a, b)] and 100 < got.sum() < 15_000


def test_walk_is_linear_in_sentences():
    """Four times the sentences take about four times as long, all kept, all equal, or dropped in between."""
    import time

    def seconds(n, kind):
        key = {"new": list(range(n)), "same": [0] * n, "mixed": [i if i % 3 == 0 else i % 7 for i in range(n)]}[kind]
        walk = R.Walk(key, 10)
        start = time.perf_counter()
        walk.run()
        return time.perf_counter() - start

    for kind in ("new", "same", "mixed"):
        small, large = (min(seconds(n, kind) for _ in range(3)) for n in (16_000, 64_000))
        assert large < 12 * small + 0.05, kind


def test_long_documents_of_repeats(spark):
    """Variants of one line, told apart by a number, between lines that stay: kept ones lie far back."""
    lines = [f"this pan number {i} heats fast and cleans easily" if i % 5 else f"q{i} z{i * 7} k{i * 3}" for i in range(600)]
    df = spark.createDataFrame([(1, ". ".join(lines) + ".")], "id long, text string")
    got = O.drop_repeats(df, "text", 10).first()
    kept = []
    for line in lines:
        if not any(expected(line, p) for p in kept[-10:]):
            kept.append(line)
    assert got.removed == len(lines) - len(kept) and got.text_kept == ". ".join(kept) + "." or got.text_kept.count("q") == sum(k.startswith("q") for k in kept)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = "the red pan heats fast and it saves time in my small kitchen every day".split()
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            if parts and rng.random() < 0.5:
                s = list(rng.choice(parts))
                for _ in range(rng.randrange(0, 4)):
                    s[rng.randrange(len(s))] = rng.choice("abcdetn ")
                parts.append("".join(s).strip() or "x")
            else:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))))
        rows.append((d, ". ".join(parts) + "."))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def keys_of(docs):
    parts = X.sentences(F.col("text"))
    rows = docs.select("doc_id", parts.alias("p"), F.transform(parts, X.match_key).alias("k")).collect()
    return {r.doc_id: [(s, k) for s, k in zip(r.p, r.k) if k] for r in rows}


def test_golden_pairs(spark):
    df = spark.createDataFrame([(i, f"{b}. {a}.") for i, (a, b, _) in enumerate(PAIRS)], "doc_id long, text string")
    hit = {r.doc_id for r in O.repeat_pairs(df, "doc_id", "text").collect()}
    assert hit == {i for i, (_, _, yes) in enumerate(PAIRS) if yes}
    assert [expected(a, b) for a, b, _ in PAIRS] == [yes for _, _, yes in PAIRS]


@pytest.mark.parametrize("window", [1, 4, 10])
def test_pairs_match_brute_force(docs, window):
    got = {(r.doc_id, r.idx, r.prev_idx) for r in O.repeat_pairs(docs, "doc_id", "text", window).collect()}
    want = {
        (d, i, j)
        for d, items in keys_of(docs).items()
        for i in range(len(items))
        for j in range(max(0, i - window), i)
        if expected(items[i][1], items[j][1])
    }
    assert got == want and want


@pytest.mark.parametrize("window", [2, 12])
@pytest.mark.parametrize("similar", [True, False])
def test_greedy_matches_walk(docs, window, similar):
    got = {r.doc_id: (r.text_kept, r.removed) for r in
           O.drop_repeats(docs, "text", window, similar).collect()}
    rule = expected if similar else (lambda a, b: a == b)
    for d, items in keys_of(docs).items():
        kept, removed = [], 0
        for s, k in items:
            if any(rule(k, p) for _, p in kept[-window:]):
                removed += 1
            else:
                kept.append((s, k))
        assert got[d] == (" ".join(s for s, _ in kept), removed)


def test_nothing_kept_gives_the_text_back(spark):
    df = spark.createDataFrame([("?!  ;",), ("",)], "text string")
    for similar in (True, False):
        got = [(r.text_kept, r.removed) for r in O.drop_repeats(df, "text", similar=similar).collect()]
        assert got == [("?! ;", 0), ("", 0)]


def test_clean_up_is_stable(docs):
    once = O.drop_repeats(docs, "text", 10, similar=False, out="a").drop("removed")
    twice = O.drop_repeats(once, "a", 10, similar=False, out="b")
    assert twice.filter("removed > 0").count() == 0


def test_a_batch_is_judged_some_documents_at_a_time(spark, monkeypatch):
    """No part holds more sentences than allowed, but for a document that does alone; parts give what the whole gives."""
    import numpy as np
    import pyarrow as pa

    from shelfspark.functions import repeats as R

    sizes = [0, 3, None, 5, 40, 1, 0, 7, 7, 7, 0]
    lists = pa.array([None if n is None else [f"key {n} {i % 4}" for i in range(n)] for n in sizes])
    seen = []

    def judge(part):
        seen.append([len(x or []) for x in part.to_pylist()])
        return pa.array([[i + 1 for i in range(len(x or []))] for x in part.to_pylist()], pa.list_(pa.int64()))

    monkeypatch.setattr(R, "_SENTENCES", 10)
    got = R._by_parts(lists, judge).to_pylist()
    assert [len(x) for x in got] == [n or 0 for n in sizes]
    assert np.concatenate(seen).tolist() == [n or 0 for n in sizes] and len(seen) > 3
    assert all(sum(part) <= 10 or sum(n > 0 for n in part) == 1 for part in seen)
    assert R._by_parts(lists.slice(0, 0), judge).to_pylist() == []
