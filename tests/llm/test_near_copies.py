"""Near copies of the pipeline against all pairs' Jaccard similarity of 5-word shingles."""

import os
import random

import numpy as np
import pytest

from shelfspark.llm import near_copies
from shelfspark.llm.simhash import planes

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w)} if 0 < len(w) <= n else {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def kept_of(rows):
    """The smallest id of each group; every pair is compared."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if group[i] != group[j] and min(len(a), len(b)) * 5 >= 4 * max(len(a), len(b)):
                n = len(a & b)
                if n * 5 >= 4 * (len(a) + len(b) - n):
                    group = [group[j] if g == group[i] else g for g in group]
    return sorted(min(d for (d, _), g in zip(rows, group, strict=True) if g == root) for root in set(group))


def kept(spark, rows):
    return sorted(r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def variants():
    """Groups of texts of many lengths with a few words changed: similarities on both sides of 0.8."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(4000)}"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  TWO"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e f")]
    for g in range(40):
        base = [word() for _ in range(r.choice([8, 20, 64, 300, 1500]))]
        for c in range(6):
            own = list(base)
            for _ in range(r.randrange(0, 1 + len(own) // 25)):
                own[r.randrange(len(own))] = word()
            rows.append((1000 * g + 100 + c, " ".join(own)))
    return rows


def test_groups_match_all_pairs(spark):
    rows = variants()
    assert kept(spark, rows) == kept_of(rows)


@here
def test_groups_of_the_documents_match_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows) == kept_of(rows)


def test_a_large_group_in_tiles(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        own = list(base)
        own[r.randrange(120)] = f"x{i}"
        rows.append((i, 0, " ".join(own)))
    rows.append((999, 0, " ".join(f"y{i}" for i in range(120))))
    made = spark.createDataFrame(rows, "node long, root long, text string").selectExpr("root", "node", "0L AS fp", "text")
    from shelfspark.llm.components import components

    found = components(near_copies.links(made, block=90)).collect()
    assert {x.node for x in found} == set(range(400)) and {x.root for x in found} == {0}


def test_common_passages_make_no_group(spark):
    """Texts that share a passage, pairwise at 0.3, meet in no list."""
    common = " ".join(f"b{i}" for i in range(100))
    rows = [(i, common + " " + " ".join(f"own{i}.{k}" for k in range(110))) for i in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    base = made.select(*near_copies.C.row_key(), "doc_id", "text")
    nodes = base.mapInArrow(near_copies._sketch_rows, "did long, rk int, doc_id long, node long, fp long, n long, sig array<long>")
    nodes = nodes.selectExpr("node", "struct(did, rk) AS first", "fp", "n", "sig")
    assert near_copies._members(nodes, made).groupBy("root").count().where("count > 9").count() == 0


def test_bit_sliced_radius():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 64, 130, dtype=np.uint64)
    apart = np.array([[bin(int(a ^ b)).count("1") for b in prints] for a in prints[:9]])
    for radius in (0, 3, 26, 31, 64):
        got = set(zip(*(x.tolist() for x in near_copies.within(planes(prints), prints[:9], 130, radius)), strict=True))
        assert got == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius)), strict=True))


def test_without_rows(spark):
    assert kept(spark, []) == []


def test_simhashes_by_plain_counting():
    r = np.random.default_rng(4)
    sizes = [1, 2, 254, 255, 256, 700, 3]
    at = np.concatenate(([0], np.cumsum(sizes)))
    hashes = r.integers(0, 1 << 64, at[-1], dtype=np.uint64)
    got = near_copies.simhashes(hashes, at)
    for w in range(near_copies.PRINT_WORDS):
        h = near_copies.C.mix(hashes + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64))) if w else hashes
        for s, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            bits = [sum(int(x) >> k & 1 for x in h[a:b]) * 2 > b - a for k in range(64)]
            assert int(got[s, w]) == sum(1 << k for k in range(64) if bits[k])


def test_candidates_meet_by_their_simhashes_alone(spark):
    """Every pair at 0.8 is in one group of near SimHashes, in blocks of any size; a row has no other key."""
    r = np.random.default_rng(5)
    sets = []
    for size in [4, 5, 8, 12, 13, 40, 200, 900] * 6:
        base = r.integers(0, 1 << 64, size, dtype=np.uint64)
        sets += [base, base[: -(-size * 4 // 5)], np.append(base, r.integers(0, 1 << 64, size // 4, dtype=np.uint64))]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    prints = near_copies.simhashes(np.concatenate(sets), at)
    rows = [(i, len(s), near_copies.C.signed(prints[i]).tolist()) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n long, sig array<long>")
    from shelfspark.llm.components import components

    for block in (5, 1000):
        root = {x.node: x.root for x in components(near_copies.near_prints(nodes, block)).collect()}
        for i in range(0, len(sets), 3):
            for j, k in ((i, i + 1), (i, i + 2)):
                few, many = sorted((len(sets[j]), len(sets[k])))
                if few * 5 >= many * 4 and few < many:
                    assert root[j] == root[k] == i
        assert len(set(root.values())) == len({v // 3 for v in root.values()})


def test_radius_bounds_the_chance():
    from math import comb

    for bits, p in ((128, 0.1612), (512, 0.1612), (512, 0.1875)):
        k = near_copies.radius(bits, p)
        tail = [sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(m + 1, bits + 1)) for m in (k - 1, k)]
        assert tail[1] <= 5e-7 < tail[0] * 1.001
