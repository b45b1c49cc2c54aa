"""MinHash near-duplicates against all pairs' shingle sets."""

import os
import random

import numpy as np
import pytest

from shelfspark.llm import minhash
from shelfspark.llm.components import components

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return {b" ".join(w)} if 0 < len(w) <= n else {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) with every pair compared."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and group[i] != group[j] and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 80 * (len(a) + len(b) - n):
                    group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(((d, len(s), least[g], d is not None and d == least[g]) for (d, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def got(spark, rows):
    made = spark.createDataFrame([(*r, 0, "clash", 0) for r in rows], "doc_id long, text string, node int, sig string, root long").repartition(3)
    out = minhash.near_duplicates(made)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def variants(seed=8):
    """Groups of texts of many lengths with a few words changed: similarities on both sides of 0.8."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "a b c d"), (8, "a b c d e f g"), (9, "a b c d e f g h"), (None, "a b c d e f g"), (None, "z z z")]
    rows += [(5, "one two"), (5, "one two"), (10, None)]
    for g in range(40):
        base = [word() for _ in range(r.choice([8, 20, 64, 300, 1500]))]
        for c in range(6):
            own = list(base)
            for _ in range(r.randrange(0, 1 + len(own) // 25)):
                own[r.randrange(len(own))] = word()
            rows.append((1000 * g + 100 + c, " ".join(own)))
    return rows


def test_components_match_all_pairs(spark):
    rows = variants()
    assert got(spark, rows) == plain(rows)


@here
def test_components_of_the_documents_match_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == plain(rows)


def members(spark, texts):
    """Of one group, with true signatures."""
    import pyarrow as pa

    rows = []
    for _, hashes, at in minhash.C.shingle_sets(pa.array(texts), 4):
        sig = minhash.C.signed(minhash.signatures(hashes, at[:-1]))
        rows += [(0, len(rows) + k, s.tolist(), texts[len(rows) + k]) for k, s in enumerate(sig)]
    return spark.createDataFrame(rows, "root long, node long, sig array<long>, text string").repartition(3)


@pytest.mark.parametrize("pivots", [1, 8])
def test_a_large_group_in_tiles(spark, pivots):
    """A family about one text, a chain that hangs on to it, and strangers."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(300):
        own = list(base)
        own[r.randrange(200)] = f"x{i}"
        texts.append(" ".join(own))
    for step in range(12):
        base = [f"c{step}.{i}" if i % 50 == step else w for i, w in enumerate(base)]
        texts.append(" ".join(base))
    texts += [" ".join(f"s{i}.{k}" for k in range(50)) for i in range(60)]
    found = components(minhash.links(members(spark, texts), minhash.match_threshold(), block=40, pivots=pivots)).collect()
    want = {d: c for d, _, c, _ in plain(list(enumerate(texts)))}
    roots = {x.node: x.root for x in found}
    assert {d: roots.get(d, d) for d in want} == want and len(set(want.values())) == 61


def test_boilerplate_is_not_posted(spark):
    """Texts that share a passage, and no pair of which is alike, meet in no list."""
    common = " ".join(f"b{i}" for i in range(100))
    texts = [common + " " + " ".join(f"own{i}.{k}" for k in range(220)) for i in range(200)]
    nodes = members(spark, texts).select("node", "sig")
    assert minhash.posts(nodes, minhash.match_threshold()).count() == 0


def test_prefix_lists_lose_no_pair_above_the_threshold():
    r = np.random.default_rng(5)
    sig = r.integers(0, 3, (200, 64)).astype(np.uint64)
    sig[100:] = sig[:100]
    for x in range(100, 200):
        sig[x, r.choice(64, r.integers(0, 45), replace=False)] = 9
    lists = minhash.Lists(sig)
    for matches in (20, 34, 60):
        met = lists.meet(sig[:100], matches)
        for x in range(100):
            alike = (sig == sig[x]).sum(axis=1) >= matches
            assert (met[x] | ~alike).all()


def test_match_threshold_keeps_the_stated_chance():
    from math import comb

    t = minhash.match_threshold()
    below = lambda t: sum(comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(t))
    assert below(t) <= 1e-6 < below(t + 1)


def test_a_star_of_many_links(spark):
    links = spark.range(1, 50_000).selectExpr("id AS a", "0L AS b").union(spark.createDataFrame([(70_001, 70_000)], "a long, b long"))
    found = components(links)
    assert found.where("root = 0").count() == 50_000 and found.where("root = 70000").count() == 2


def test_without_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 0, 1, True)]
