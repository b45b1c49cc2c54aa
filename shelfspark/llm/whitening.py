"""Embedding whitening by polarisation covariance.

Components become integers and the fit list is each distinct vector once. Where n is its
length and S its sum, c = n * x - S is the exact centred value of a dimension, and c_i + c_j
that of the sum of two dimensions. Tasks add up the squares of both, as whole numbers, one
row for each dimension and pair of dimensions; differences of these variances give
all cross-covariances:

    2 * sum(c_i * c_j) = sum((c_i + c_j)**2) - sum(c_i**2) - sum(c_j**2).

Sums travel as limbs of 40 bits, so that Spark adds plain longs and no size of the table
rounds or overflows them. Only the dimensions' sums and variances (D * (D + 1) / 2 numbers)
reach the driver, which divides once, in whole numbers, and calls ``eigh``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import common as C

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Entries of a larger size after scaling take no part, as those that are not finite.
LARGEST = 1 << 45
_LIMB = 40
#: Half of the bits of a centred value whose square takes three products.
_HALF = 26
_ROWS = 1024


def fixed_points(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) with x = floor(scale * c) + shift for each entry c, taken as double.

    Left out: null or empty vectors, vectors with an entry that is null, not finite or
    beyond ``LARGEST`` when scaled, and vectors of another length than most have (of lengths
    equally common the greater one stays).
    """
    entry = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * scale) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entry.alias("c"))
    rows = rows.where((F.size("c") > 0) & F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", F.transform("c", lambda e: F.floor(e * scale) + F.lit(shift).cast("long")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (usual["size"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _slices(batches, name: str = "x"):
    """(rows of a batch, their matrix), at most ``_ROWS`` rows each."""
    for batch in batches:
        for a in range(0, batch.num_rows, _ROWS):
            part = batch.slice(a, _ROWS)
            yield part, _matrix(part.column(part.schema.get_field_index(name)))


def _limbs(totals: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Whole numbers of any size as rows (i, j, limb, value): value * 2**(40 * limb) add up to them."""
    out: tuple[list, ...] = ([], [], [], [])
    for i, j, total in totals:
        sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
        while rest:
            for column, v in zip(out, (i, j, limb, sign * (rest & ((1 << _LIMB) - 1))), strict=True):
                column.append(v)
            rest >>= _LIMB
            limb += 1
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["i", "j", "limb", "value"])


_LIMB_ROWS = "i int, j int, limb int, value long"


def _whole(rows: DataFrame) -> dict[tuple[int, int], int]:
    """The totals of all tasks' limbs; as many as there are pairs of dimensions."""
    sums = rows.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in sums:
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (int(r.value) << (_LIMB * r.limb))
    return out


def _sums(batches):
    total = None
    for _, x in _slices(batches):
        # A sum of 1024 entries of 46 bits fits a long; the running total is a Python number.
        s = x.sum(axis=0).astype(object)
        total = s if total is None else total + s
    if total is not None:
        yield _limbs([(i, i, int(v)) for i, v in enumerate(total)])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where every value is below 2**51, as Python numbers elsewhere."""
    low = [s // n for s in sums]
    rest = [s - n * a for s, a in zip(sums, low, strict=True)]
    near = x.astype(object) - np.array(low, dtype=object) if any(abs(a) > 1 << 61 for a in low) else x - np.array(low, dtype=np.int64)
    if len(near) and (int(np.abs(near).max()) + 1) * n >= 1 << 51:
        return near.astype(object) * n - np.array(rest, dtype=object)
    return near.astype(np.int64) * n - np.array(rest, dtype=np.int64)


def squares(c: np.ndarray) -> np.ndarray:
    """The exact sum of squares of each column of at most 1024 rows, as Python numbers."""
    if c.dtype == object or not len(c):
        return (c.astype(object) ** 2).sum(axis=0) if len(c) else np.zeros(c.shape[1], object)
    if int(np.abs(c).max()) < 1 << 26:
        return np.einsum("ij,ij->j", c, c).astype(object)
    high, low = c >> _HALF, c & ((1 << _HALF) - 1)
    parts = [np.einsum("ij,ij->j", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return (parts[0] << 2 * _HALF) + (parts[1] << _HALF + 1) + parts[2]


def _variances(n: int, sums: list[int]):
    """Sums of squares: (i, i) of dimension i, (i, j) of the sum of dimensions i < j."""

    def rows(batches):
        d = len(sums)
        own, both = np.zeros(d, object), [np.zeros(d - i - 1, object) for i in range(d)]
        for _, x in _slices(batches):
            c = centred(x, n, sums)
            own = own + squares(c)
            for i in range(d - 1):
                both[i] = both[i] + squares(c[:, i + 1 :] + c[:, i : i + 1])
        yield _limbs([(i, i, int(v)) for i, v in enumerate(own)] + [(i, i + 1 + k, int(v)) for i, line in enumerate(both) for k, v in enumerate(line)])

    return rows


def covariance(totals: dict[tuple[int, int], int], d: int, n: int) -> np.ndarray:
    """The covariances, each rounded once, from sums of squares of n * x - S (see ``_variances``)."""
    v = np.zeros((d, d))
    for i in range(d):
        a = totals.get((i, i), 0)
        v[i, i] = a / n**3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (totals.get((i, j), 0) - a - totals.get((j, j), 0)) / (2 * n**3)
    return v


@dataclass(frozen=True)
class Whitening:
    """A fit: list length, sums of the dimensions, covariance, and its leading eigenpairs."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whitened, centred values) of rows; not a number where a component has no variance."""
        c = centred(x, self.n, self.sums)
        near = (c / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (near @ self.vectors) / np.sqrt(self.values), np.nan), c


def fit_list(points: DataFrame) -> DataFrame:
    """(x): each vector of ``points`` (see ``fixed_points``) once, as a written table."""
    return C.stage(points.select("x").distinct(), "distinct")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None if it is empty."""
    n = distinct.count()
    if not n:
        return None
    d = len(distinct.first()["x"])
    added = _whole(distinct.mapInArrow(_sums, _LIMB_ROWS))
    sums = [added.get((i, i), 0) for i in range(d)]
    v = covariance(_whole(distinct.mapInArrow(_variances(n, sums), _LIMB_ROWS)), d, n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(v))
    # What rounding leaves of a component without variance is none.
    values = np.where(values > trace * d * np.finfo(float).eps, values, 0.0)
    return Whitening(n, sums, v, values, vectors, values / trace if trace else np.zeros(len(values)))


def identity_error(distinct: DataFrame, made: Whitening) -> float:
    """The largest entry, less the identity, of the covariance that the whitened fit list really has.

    Sums of products over all distinct rows; means of whitened rows are zero, as c sums
    to zero exactly. Components without variance do not count.
    """
    live = np.flatnonzero(made.values > 0)
    if not len(live):
        return 0.0

    def products(batches):
        total = np.zeros((len(live), len(live)))
        for _, x in _slices(batches):
            w = made.apply(x)[0][:, live]
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"]
        )

    found = np.zeros((len(live), len(live)))
    for r in distinct.mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        found[r.i, r.j] = r.value / made.n
    return float(np.abs(found - np.eye(len(live))).max())


def _deviations(c: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; null where it does not fit a long."""
    turned = np.concatenate([squares(c.T[a : a + _ROWS])[None, :] for a in range(0, c.shape[1], _ROWS)]).sum(axis=0) if len(c) else []
    return [int(v) if v < 1 << 63 else None for v in turned]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row and component.

    A row for each row that ``fixed_points`` keeps and each of the ``components`` leading
    components (all, if the vectors are shorter); repeated rows, also of one vec_id, are
    each returned but fitted once; vec_id may be null. Components are numbered by falling
    eigenvalue; among equal ones any order holds, the same for all rows. One without
    variance has whitened null and explained 0. A deviation beyond a long is null. An empty
    table gives no rows; other columns are ignored.
    """
    points = C.stage(fixed_points(vectors), "points")
    distinct = fit_list(points)
    made = fit(distinct, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if made is None:
        return points.sparkSession.createDataFrame([], schema)
    error, k = identity_error(distinct, made), len(made.values)

    def rows(batches):
        for part, x in _slices(batches):
            w, c = made.apply(x)
            m = len(w)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, made.n)), pa.array(_deviations(c), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(made.explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.mapInArrow(rows, schema)
