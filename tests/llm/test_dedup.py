"""Substring dedup, SimHash and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import simhash, substring_dedup
from shelfspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, did string, rk string, path string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


def removed(rows, k):
    """doc_id, words, removed words, digest of the kept ones; every window is compared with every other."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[a : a + k]) for _, w in words for a in range(len(w) - k + 1))
    out = []
    for i, w in words:
        cut = set()
        for a in range(len(w) - k + 1):
            if seen[tuple(w[a : a + k])] > 1:
                cut.update(range(a, a + k))
        kept = b" ".join(x for n, x in enumerate(w) if n not in cut)
        out.append((i, len(w), len(cut), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def messy_rows(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["ä", "né", "\u00a0x", "I"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [text(n) for n in (34, 35, 36, 60, 200)]
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, text(50)), (None, text(50)), (4, text(34)), (4, text(80)), (5, "la " * 90), (6, "da " * 35)]
    for i in range(10, 60):
        parts = [text(r.randrange(0, 70)) for _ in range(4)]
        parts.insert(r.randrange(4), r.choice(shared))
        if i % 3 == 0:
            parts.insert(r.randrange(4), r.choice(shared))
        rows.append((i, r.choice([" ", "\n", "\t\x0b"]).join(parts)))
    copy = rows[20][1].split()
    copy[len(copy) // 2] = "changed"
    rows += [(100, rows[20][1]), (101, rows[20][1]), (101, rows[20][1]), (102, " ".join(copy)), (103, text(30000) + " " + shared[3])]
    return rows


def test_removed_words_match_brute_force(spark):
    rows = messy_rows()
    for k in (35, 5):
        got = substring_dedup.remove_repeats(docs_of(spark, rows), k=k, digest=True).collect()
        assert sorted((tuple(r) for r in got), key=str) == removed(rows, k)


def test_texts_without_repeats_stay_as_they_are(spark):
    rows = [(1, " a  b\n c"), (2, None), (3, "x " * 40 + "\n")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs_of(spark, rows), more=("lang",)).collect()}
    assert (got[1].text, got[1].lang, got[2].text, got[3].text, got[3].n_removed) == (" a  b\n c", "en", None, "", 40)


def test_paths_are_compacted(spark):
    body = " ".join(f"t{i}" for i in range(500))
    rows = [(1, "a b c " + body), (2, body + " d e f"), (3, body)]
    paths, _ = substring_dedup.repeated_paths(docs_of(spark, rows))
    runs = substring_dedup.runs_of(docs_of(spark, rows)).count()
    found = paths.collect()
    assert len(found) < runs / 3 and {p.copies for p in found} <= {2, 3}


def test_removal_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return sorted(((d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_rows():
    r = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "One two"), (7, "one TWO three"), (None, "lonely text without an id"), (None, None)]
    for g in range(12):
        base = [f"v{r.randrange(5000)}" for _ in range(300)]
        for c in range(8):
            own = list(base)
            for _ in range(c):
                own[r.randrange(len(own))] = f"z{c}"
            rows.append((100 * (g + 1) + c, " ".join(own)))
    return [*rows, (100, rows[9][1]), (9999, "Ä ä " * 3000)]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == groups(rows)


def test_keep_one_keeps_the_smallest_id_of_each_group(spark):
    rows = near_rows()
    kept = [r.doc_id for r in simhash.keep_one(docs_of(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted({c for _, _, c in groups(rows)}, key=str)


def test_links_survive_keys_cut_into_many_blocks(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    prints = {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    wide, tight = ({(c.node, c.root) for c in components(simhash.links(df, block=b)).collect()} for b in (4096, 8))
    assert wide == tight and wide


def test_bit_sliced_distances():
    r = np.random.default_rng(2)
    right = r.integers(0, 2**64, 130, dtype=np.uint64)
    left = right[:40] ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(3) << r.integers(0, 62, 40).astype(np.uint64))
    a, b = simhash.near(simhash.planes(right), left, len(right))
    want = {(i, j) for i, x in enumerate(left.tolist()) for j, y in enumerate(right.tolist()) if bin(x ^ y).count("1") <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 4000), (4000, 4500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(100))
    assert (got[5000], got[4500], got[4000]) == (4000, 4000, 4000)


def test_every_removed_word_repeats_elsewhere(spark):
    rows = messy_rows(8)
    got = substring_dedup.remove_repeats(docs_of(spark, rows)).agg(F.sum("n_removed")).first()[0]
    assert got == sum(r[2] for r in removed(rows, 35))
