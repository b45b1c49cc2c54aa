"""Whitening against whole-number and dense computations over all rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from shelfspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n string, x string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def points(rows):
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]


def exact(rows):
    """n, sums, and the covariances as fractions of the distinct vectors."""
    seen = sorted({tuple(x) for _, x in points(rows)})
    n, d = len(seen), len(seen[0])
    s = [sum(x[i] for x in seen) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in seen), n**3) for j in range(d)] for i in range(d)]
    return n, s, v


def made(seed, n, d, scale=1.0):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d)) * scale
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(r.normal(size=(n, d)) @ mix + 3 * scale)]


@pytest.mark.parametrize("d", [2, 5, 24])
def test_rows_match_whole_number_covariance(spark, d):
    rows = made(d, 300, d)
    rows += rows[:40] + [(None, rows[3][1]), (7, rows[9][1])]
    n, s, v = exact(rows)
    dense = np.array([[float(c) for c in line] for line in v])
    values, vectors = np.linalg.eigh(dense)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    k = min(16, d)
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    at = {}
    for r in got:
        at.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for i, x in points(rows):
        c = [n * a - b for a, b in zip(x, s, strict=True)]
        own = at[i, sum(a * a for a in c)]
        assert sorted(own) == list(range(1, k + 1))
        want = (np.array([float(Fraction(a, n)) for a in c]) @ vectors[:, :k]) / np.sqrt(values[:k])
        assert np.allclose(np.abs([own[j + 1].whitened for j in range(k)]), np.abs(want), rtol=1e-7, atol=1e-7)
        assert np.allclose([own[j + 1].explained for j in range(k)], values[:k] / np.trace(dense), rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_covariances_are_recovered_exactly(spark):
    rows = made(4, 150, 6)
    n, s, v = exact(rows)
    fitted = whitening.fit(whitening.fit_list(whitening.fixed_points(frame(spark, rows))))
    assert (fitted.n, fitted.sums) == (n, s)
    assert fitted.covariance.tolist() == [[float(c) for c in line] for line in v]


@pytest.mark.parametrize("size", [1 << 20, 1 << 40, 1 << 51, 1 << 60])
def test_squares_of_any_size_are_exact(size):
    r = np.random.default_rng(1)
    c = r.integers(-size, size, (1000, 3))
    if size > 1 << 52:
        c = c.astype(object)
    assert whitening.squares(c).tolist() == [sum(int(a) ** 2 for a in c[:, j]) for j in range(3)]


def test_centred_values_of_long_lists_are_exact():
    x = np.array([[1_000_000, 2 << 40], [999_990, 5]])
    for n in (3, 50_000_000_000):
        sums = [n * 1_000_003 + 1, n * 17 - 1]
        assert whitening.centred(x, n, sums).tolist() == [[n * int(a) - b for a, b in zip(row, sums, strict=True)] for row in x]


def test_limbs_add_up():
    totals = [(0, 0, 0), (0, 1, 1), (1, 1, -(1 << 130) + 12345), (2, 2, 1 << 40)]
    seen = {}
    for r in whitening._limbs(totals).to_pylist():
        seen[r["i"], r["j"]] = seen.get((r["i"], r["j"]), 0) + (r["value"] << 40 * r["limb"])
    assert seen == {(0, 1): 1, (1, 1): -(1 << 130) + 12345, (2, 2): 1 << 40}


def test_rows_without_a_sound_vector_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1e300, 0.0]), (8, [1.0]), (9, [4.0, -1.0]), (10, [0.0, 0.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 9, 10} and len(got) == 6 and {r.n for r in got} == {3}


def test_components_without_variance(spark):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in got) and len(got) == 15
    assert {round(r.explained, 9) for r in got} == {0.0, 1.0}
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.n == 1 for r in same)


def test_without_rows(spark):
    got = whitening.whiten(frame(spark, []))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
