"""Exact top-k inner products by block-at-a-time pruning.

Vectors of quantised integers stand in blocks of consecutive ids; a block is a forward
index (its ids and components) with the largest and smallest value of each component.
The sum over a query's components of the better product bounds every score in the block.
Sixteen blocks make a shelf, queries stand in groups, and one row of a join is a group
against a shelf: each query takes the shelf's blocks from the best bound down, keeps its k
best, and stops where the bounds fall below the k-th. A first wave meets one shelf of each
group; its k-th scores are the bars of the second wave. There groups meet the bounds of the other
shelves first, without their vectors; a shelf is brought only to the groups of which some query's
bound reaches its bar.

Bounds that equal the k-th score are scored, so ties are whole. Neither side is broadcast
or gathered: shelves and groups have a fixed size and their number grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import common as C

BLOCK = 1024
#: Blocks of a shelf.
SHELF = 16
GROUP = 256
_NONE = -(1 << 63)


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, dim, v) with v = floor(scale * x) for each component, x as double.

    Left out: null vec_id, null or empty vectors, vectors with a null or non-finite
    component. Rows alike in id and values count once.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    sound = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
    return rows.distinct()


def _pack(size: int, block: int):
    """Rows in order to rows of ``size`` vectors: dim, ids, v, and hi, lo of each ``block`` of them."""

    def rows(batches):
        held: dict[int, tuple[list, list]] = {}

        def packed(dim: int):
            ids, values = held.pop(dim)
            matrix = np.array(values, dtype=np.int64).reshape(len(ids), dim)
            starts = np.arange(0, len(ids), block)
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([dim], pa.int32()),
                "ids": pa.array([np.array(ids, dtype=np.int64).tobytes()], pa.binary()),
                "v": pa.array([matrix.tobytes()], pa.binary()),
                "hi": pa.array([np.maximum.reduceat(matrix, starts, axis=0).tobytes()], pa.binary()),
                "lo": pa.array([np.minimum.reduceat(matrix, starts, axis=0).tobytes()], pa.binary()),
            })

        for batch in batches:
            for i, dim, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "dim", "v")), strict=True):
                ids, values = held.setdefault(dim, ([], []))
                ids.append(i)
                values.append(v)
                if len(ids) == size:
                    yield packed(dim)
        for dim in sorted(held):
            yield packed(dim)

    return rows


def packed_rows(vectors: DataFrame, size: int, block: int, name: str) -> DataFrame:
    """(``name``, dim, ids, v, hi, lo): vectors of consecutive ids, ``size`` to a row."""
    rows = (
        vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
        .mapInArrow(_pack(size, block), "dim int, ids binary, v binary, hi binary, lo binary")
    )
    return C.stage(rows.withColumn(name, F.monotonically_increasing_id()), name)


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """As doubles where every sum of products of two of them is exact in doubles, else as int64."""
    most = max(float(np.abs(m.astype(np.float64)).max(initial=0)) for m in matrices)
    fits = 2 * most * most * matrices[0].shape[1] < 2**50
    return [m.astype(np.float64) if fits else m for m in matrices]


def _read(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64).reshape(-1, dim)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row; ties to the earlier place."""
    n = score.shape[1]
    if n <= k:
        return np.repeat(np.arange(n)[None, :], len(score), axis=0)
    if abs(score).max(initial=0) < 2**50:
        return np.argpartition(score * -n + np.arange(n)[None, :], k - 1, axis=1)[:, :k]
    return np.argsort(~score, axis=1, kind="stable")[:, :k]


def _search(k: int, size: int):
    """The k best of each query of a group on a shelf, at or above its bar: (query_id, vec_id, score)."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q, own = _read(row["qv"], dim), np.frombuffer(row["qids"], dtype=np.int64)
                ids = np.frombuffer(row["ids"], dtype=np.int64)
                raw, hi, lo = (_read(row[c], dim) for c in ("v", "hi", "lo"))
                bound = _bounds(q, hi, lo)
                q, v = _exact(q, raw)
                bar = np.frombuffer(row["bar"], dtype=np.int64) if row.get("bar") else np.full(len(own), _NONE)
                floor = bar.copy()
                order = np.argsort(-bound, axis=1, kind="stable")
                best = np.full((len(own), k), _NONE)
                best_id = np.full((len(own), k), np.iinfo(np.int64).max)
                live = np.arange(len(own))
                for step in range(bound.shape[1]):
                    block = order[live, step]
                    go = bound[live, block] >= floor[live]  # bounds only fall from here on
                    live, block = live[go], block[go]
                    if not len(live):
                        break
                    for j in np.unique(block).tolist():
                        who = live[block == j]
                        part = slice(j * size, min(len(ids), (j + 1) * size))
                        score = (q[who] @ v[part].T).astype(np.int64)
                        other = own[who][:, None] != ids[part][None, :]
                        place = _top(np.where(other, score, -(1 << 49)) if abs(score).max(initial=0) < 2**49 else np.where(other, score, _NONE), k)
                        new = np.where(np.take_along_axis(other, place, 1), np.take_along_axis(score, place, 1), _NONE)
                        all_s = np.concatenate([best[who], new], axis=1)
                        all_i = np.concatenate([best_id[who], ids[part][place]], axis=1)
                        first = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
                        best[who] = np.take_along_axis(all_s, first, 1)
                        best_id[who] = np.take_along_axis(all_i, first, 1)
                        floor[who] = np.maximum(bar[who], best[who, k - 1])
                a, b = np.nonzero((best > _NONE) & (best >= bar[:, None]))
                if len(a):
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(own[a]), "vec_id": pa.array(best_id[a, b]), "score": pa.array(best[a, b])})

    return rows


def _bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The most that each query can score in each block."""
    up, down, hi, lo = _exact(np.maximum(q, 0), np.minimum(q, 0), hi, lo)
    return up @ hi.T + down @ lo.T


def _worth(batches):
    """(group, shelf) where some query of the group may reach its bar."""
    for batch in batches:
        kept = []
        for row in batch.to_pylist():
            q, hi, lo = (_read(row[c], row["dim"]) for c in ("qv", "hi", "lo"))
            if (_bounds(q, hi, lo).max(axis=1) >= np.frombuffer(row["bar"], dtype=np.int64)).any():
                kept.append((row["group"], row["shelf"]))
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], names=["group", "shelf"])


def _bars(batches):
    """k-th best scores in the order of a group's queries."""
    for batch in batches:
        out = []
        for ids, seen in zip(batch.column("ids").to_pylist(), batch.column("seen").to_pylist(), strict=True):
            bar = {r["query_id"]: r["bar"] for r in seen or ()}
            out.append(np.array([bar.get(i, _NONE) for i in np.frombuffer(ids, dtype=np.int64).tolist()], dtype=np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(out, pa.binary())], names=["group", "bar"])


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block: int = BLOCK, shelf: int = SHELF, group: int = GROUP
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` highest integer inner products.

    Candidates are all rows but those of the query's own vec_id and those of another
    length; ties go to the smaller vec_id; fewer than ``k`` candidates give fewer rows.
    Different vectors under one vec_id are each a candidate, and together one query.
    Rows left out by ``quantise`` take no part; other columns are ignored. Scores are exact
    while they fit a long.
    """
    rows = C.stage(quantise(vectors, scale), "vectors")
    shelves = packed_rows(rows, block * shelf, block, "shelf")
    groups = packed_rows(rows.where(is_query), group, group, "group")
    places = max(1, shelves.count())
    stocked = shelves.withColumn("at", F.pmod(F.xxhash64("shelf"), F.lit(places)).cast("int"))
    asked = groups.select("group", "dim", F.col("ids").alias("qids"), F.col("v").alias("qv"), F.pmod(F.xxhash64("group"), F.lit(places)).cast("int").alias("home"))
    schema = "query_id long, vec_id long, score long"
    first = asked.withColumn("at", F.col("home")).join(stocked, ["dim", "at"]).drop("home").mapInArrow(_search(k, block), schema)
    first = C.stage(_best(first, k), "first")
    reached = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    named = groups.select("group", "ids").mapInArrow(_names, "group long, query_id long")
    seen = named.join(reached, "query_id").groupBy("group").agg(F.collect_list(F.struct("query_id", "bar")).alias("seen"))
    bars = C.stage(groups.select("group", "ids").join(seen, "group", "left").mapInArrow(_bars, "group long, bar binary"), "bars")
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: i != F.col("home"))).alias("at")
    barred = asked.join(bars, "group")
    edges = stocked.select("dim", "at", "shelf", "hi", "lo")
    worth = barred.select("group", "dim", "qv", "bar", others).join(edges, ["dim", "at"]).mapInArrow(_worth, "group long, shelf long")
    # Written first: both sides of the join that brings the vectors are plain shuffles then.
    met = C.stage(worth, "worth").join(barred.select("group", "qids", "qv", "bar"), "group")
    rest = met.join(shelves, "shelf").mapInArrow(_search(k, block), schema)
    # A query stands in one group, so no pair comes from both waves.
    every = first.select("query_id", "vec_id", "score").union(rest)
    return _best(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _names(batches):
    for batch in batches:
        ids = [np.frombuffer(x, dtype=np.int64) for x in batch.column("ids").to_pylist()]
        groups = batch.column("group").to_numpy()
        n = [len(x) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(groups, n)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], names=["group", "query_id"]
        )
