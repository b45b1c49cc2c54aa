"""Substring dedup by De Bruijn compaction of token k-mers.

Edges of the graph are the windows of ``k`` words; two windows that follow each other
share a node. Like compactors that bucket edges by minimiser, runs of edges with the
same minimiser travel as one row (a *run*), so the shuffle sees a thirteenth of the
windows:

1. every document becomes runs (bucket hash ``m``, content hash ``s``, place);
   equal windows have equal minimisers, so an edge repeats only inside a bucket that
   repeats: buckets with one run are dropped by a join;
2. runs whose content occurs again are repeated as a whole. In a document neighbouring
   runs are compacted into one path while the node between them does not branch: all
   occurrences of the first run go on to the same next run, equally often. Counts come
   by a join on the run;
3. runs that occur once in a repeated bucket (where copies part) are read again at their
   source coordinates; their edges, and those of one copy of each other run of the
   bucket, are counted one by one;
4. covered spans meet their texts by document key.

Keys are two independent 64-bit hashes. Hot runs and edges are counted with map-side
sums and joined, never gathered; a document is the only thing kept together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import common as C

#: Words in a minimiser; the rest of the window is its range of places.
SEED_WORDS = 7
_LINK = (1 << 28) - 1
_SEEDS = C.Powers(0xA24BAED4963EE407)


def _mins(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of each window of ``width``."""
    view = np.lib.stride_tricks.sliding_window_view(x, width)
    return view.argmin(axis=1) + np.arange(len(view))


def _runs(tokens: np.ndarray, first: np.ndarray, k: int):
    """Runs of all windows: text number, m, s, first window (in the text), windows, link."""
    seed = max(min(SEED_WORDS, k), k - 62)  # a run has 63 windows at most
    width = k - seed + 1
    if len(tokens) < k:
        return None
    seeds = C.Sequence(C.mix(tokens), _SEEDS).windows(seed)
    place = _mins(seeds, width)
    text = np.searchsorted(first, np.arange(len(place)), "right") - 1
    inside = np.arange(len(place)) + k <= first[text + 1]
    fresh = np.ones(len(place), dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(fresh & inside)
    if not len(lo):
        return None
    n = np.add.reduceat(inside, lo) if len(lo) else lo
    s = C.Sequence(tokens).runs(lo, lo + n + k - 1)
    owner = text[lo]
    link = np.zeros(len(lo), dtype=np.int64)
    same = owner[1:] == owner[:-1]
    link[:-1] = np.where(same, (s[1:] >> C.U64(36)).astype(np.int64) | 1, 0)
    return owner, seeds[place[lo]], s, lo - first[owner], n, link


def _run_rows(k: int):
    def rows(batches):
        for batch in batches:
            did, rk = batch.column("did").to_numpy(), batch.column("rk").to_numpy()
            for a, b, raw, at in C.text_chunks(batch.column("text")):
                start, end, first = C.word_spans(raw, at)
                found = _runs(C.span_hashes(raw, start, end), first, k)
                if found is None:
                    continue
                owner, m, s, lo, n, link = found
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(C.signed(m)), pa.array(C.signed(s)),
                        pa.array(did[a:b][owner]), pa.array(rk[a:b][owner]),
                        pa.array((lo << 34) | (n.astype(np.int64) << 28) | link),
                    ],
                    names=["m", "s", "did", "rk", "at"],
                )

    return rows


def _edge_rows(k: int):
    """Single edges of the listed runs of a document: (m, h, did, rk, lo, open)."""

    def rows(batches):
        for batch in batches:
            did, rk = batch.column("did").to_numpy(), batch.column("rk").to_numpy()
            lists = batch.column("runs")
            bounds = np.asarray(lists.offsets)
            flat = lists.values
            at_all = flat.field("at").to_numpy()
            m_all, open_all = flat.field("m").to_numpy(), flat.field("open").to_numpy(zero_copy_only=False)
            for a, b, raw, at in C.text_chunks(batch.column("text")):
                start, end, first = C.word_spans(raw, at)
                seq = C.Sequence(C.span_hashes(raw, start, end))
                r0, r1 = bounds[a], bounds[b]
                owner = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                places, m, opened = at_all[r0:r1], m_all[r0:r1], open_all[r0:r1]
                lo, n = places >> 34, (places >> 28) & 63
                each = np.repeat(np.arange(len(lo)), n)
                begin = C.ragged(first[owner] + lo, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m[each]), pa.array(C.signed(seq.runs(begin, begin + k))),
                        pa.array(did[a:b][owner[each]]), pa.array(rk[a:b][owner[each]]),
                        pa.array(begin - first[owner[each]]), pa.array(opened[each]),
                    ],
                    names=["m", "h", "did", "rk", "lo", "open"],
                )

    return rows


def _docs(docs: DataFrame, *more: str) -> DataFrame:
    return C.documents_of(docs, *more).select(*C.row_key(), "doc_id", "text", *more)


def runs_of(docs: DataFrame, k: int = 35) -> DataFrame:
    """One row per run of edges: m, s, did, rk, at (first window, windows, link to the next run)."""
    return _docs(docs).select("did", "rk", "text").mapInArrow(
        _run_rows(k), "m long, s long, did long, rk int, at long"
    )


def repeated_paths(docs: DataFrame, k: int = 35) -> tuple[DataFrame, DataFrame]:
    """(paths, loose): compacted repeated paths (did, rk, lo, n, copies), and runs to read edge by edge.

    ``lo`` is the first word of a path's first window, ``n`` its number of windows: it
    covers ``n + k - 1`` words. ``loose`` has (did, rk, runs: array of (at, m, open)).
    """
    runs = C.stage(runs_of(docs, k), "runs")
    # Written, so that both sides of the join are shuffles that Spark can split where a bucket is hot.
    twice = C.stage(runs.groupBy("m").count().where("count > 1").select("m"), "twice")
    again = C.stage(runs.join(twice, "m"), "buckets")
    link = F.col("at").bitwiseAND(F.lit(_LINK))
    kinds = C.stage(
        again.groupBy("m", "s").agg(
            F.count(F.lit(1)).alias("copies"),
            (F.min(link) == F.max(link)).alias("one_way"),
            F.min(F.struct("did", "rk", "at")).alias("place"),
        ),
        "kinds",
    )
    parted = C.stage(kinds.where("copies = 1").select("m").distinct(), "parted")
    loose = (
        kinds.join(parted, "m")
        .groupBy(F.col("place.did").alias("did"), F.col("place.rk").alias("rk"))
        .agg(F.collect_list(F.struct(F.col("place.at").alias("at"), "m", (F.col("copies") == 1).alias("open"))).alias("runs"))
    )
    here = Window.partitionBy("did", "rk").orderBy("at")
    lo, n = F.shiftright("at", 34), F.shiftright("at", 28).bitwiseAND(F.lit(63))
    whole = again.join(kinds.where("copies > 1").select("m", "s", "copies", "one_way"), ["m", "s"])
    goes_on = (
        F.lag("one_way").over(here)
        & (F.lag("copies").over(here) == F.col("copies"))
        & (F.lag(lo + n).over(here) == lo)
    )
    paths = (
        whole.select("did", "rk", "at", "copies", lo.alias("lo"), n.alias("n"), F.coalesce(goes_on, F.lit(False)).alias("goes_on"))
        .withColumn("path", F.sum((~F.col("goes_on")).cast("int")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("did", "rk", "path")
        .agg(F.min("lo").alias("lo"), F.sum("n").alias("n"), F.first("copies").alias("copies"))
        .drop("path")
    )
    return paths, loose


def _cut_rows(k: int, keep_text: bool):
    """doc_id, counts and kept words of each document, from its covered windows."""

    def rows(batches):
        for batch in batches:
            spans = batch.column("spans")
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            held = np.asarray(spans.is_valid())
            bounds, flat = np.asarray(spans.offsets), spans.values
            lo_all, n_all = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            n_words, removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                n_words.append(len(words))
                r0, r1 = bounds[i], bounds[i + 1]
                if held[i] and r1 > r0:
                    lo, n = lo_all[r0:r1], n_all[r0:r1]
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, lo, 1)
                    np.add.at(step, lo + n + k - 1, -1)
                    covered = np.cumsum(step)[:-1] > 0
                    removed.append(int(covered.sum()))
                    words = [words[j] for j in np.flatnonzero(~covered)]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            out = [ids, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64())]
            names = ["doc_id", "n_words", "n_removed"]
            if keep_text:
                plain = [t if not r else w.decode("utf-8", "replace") for t, r, w in zip(texts, removed, kept, strict=True)]
                out, names = [*out, pa.array(plain, pa.string())], [*names, "text"]
            else:
                out, names = [*out, pa.array([hashlib.sha256(w).hexdigest() for w in kept])], [*names, "kept_sha256"]
            extra = [c for c in batch.schema.names if c not in ("doc_id", "text", "spans")]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(c) for c in extra)], names=[*names, *extra])

    return rows


def remove_repeats(docs: DataFrame, k: int = 35, digest: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a window of ``k`` words that also starts anywhere else.

    Returns one row per input row: doc_id, n_words, n_removed, the ``more`` columns, and
    text (as it was if nothing went, else the kept words joined by one space) or, with
    ``digest``, kept_sha256. Null and empty texts have no words; texts under ``k`` words
    keep all; repeated rows count as occurrences of each other; rows without doc_id are
    told apart by their text; other columns are ignored.
    """
    paths, loose = repeated_paths(docs, k)
    base = _docs(docs, *more)
    edges = base.join(loose, ["did", "rk"]).select("did", "rk", "text", "runs", "doc_id", *more)
    edges = edges.mapInArrow(_edge_rows(k), "m long, h long, did long, rk int, lo long, open boolean")
    edge = F.struct("m", "h").alias("edge")  # another key than the sums': both sides are shuffled, hot ones split
    shared = edges.groupBy("m", "h").count().where("count > 1").select(edge)
    single = edges.where("open").select(edge, "did", "rk", "lo").join(shared, "edge").select("did", "rk", "lo", F.lit(1).cast("long").alias("n"))
    spans = (
        paths.select("did", "rk", F.col("lo").cast("long").alias("lo"), F.col("n").cast("long").alias("n"))
        .union(single)
        .groupBy("did", "rk")
        .agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
    )
    kinds = dict(base.dtypes)
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "text string")
    schema += "".join(f", `{c}` {kinds[c]}" for c in more)
    return (
        base.join(spans, ["did", "rk"], "left")
        .select("doc_id", "text", "spans", *more)
        .mapInArrow(_cut_rows(k, not digest), schema)
    )
