"""Ranked lexical search over a length-stratified index.

Documents of equal normaliser m form a stratum: in it the impact of a term depends on its tf
alone. A stratum is held in cells of bounded size; a cell is a small inverted index, whose
postings stand term by term, highest tf first, so that the impact of each (term, tf) is
computed once for all documents under it.

A search first needs, of each stratum and asked term, only the highest tf: the summed
impacts bound every score in the stratum. Each item visits its strata in falling order of
these bounds until they hold ``FIRST`` documents; its k-th score so far is the bar for the
second wave, in which it meets the strata whose bounds reach the bar, and no others. In a
cell the bounds are taken again from the cell's own highest tf, against the bar and against
what the task has scored already. Bounds that equal a bar are scored, so ties are whole.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import common as C

#: Documents and bytes of text in a cell (a longer text is a cell of its own).
CELL, CELL_BYTES = 4096, 4 << 20
#: Documents that an item meets in the first wave, at least.
FIRST = 1 << 14
#: Items that stand in one block.
GROUP = 256
#: Postings and sums that a task holds at once.
_SPAN = 1 << 21

_CELL = "m long, ids array<long>, terms array<string>, df array<int>, top array<int>, hashes binary, run_at binary, run_tf binary, post_at binary, posts binary"


@dataclass(frozen=True)
class Index:
    """``cells`` (see ``_CELL``), ``strata`` (m, docs), and the numbers N and L of the whole table."""

    cells: DataFrame
    strata: DataFrame
    documents: int
    terms: int


def _counts(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text."""
    out = [np.zeros(0, np.int64)]
    for _, _, raw, at in C.text_chunks(texts):
        out.append(np.diff(C.word_spans(C.TERMS[raw], at)[2]))
    return np.concatenate(out).astype(np.int64)


def _lengths(batches):
    """(n, docs, size) of each batch: how many texts have n terms, and their bytes."""
    for batch in batches:
        texts = batch.column("text")
        n, back = np.unique(_counts(texts), return_inverse=True)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(n), pa.array(np.bincount(back, minlength=len(n)).astype(np.int64)), pa.array(np.bincount(back, weights=size, minlength=len(n)).astype(np.int64))],
            names=["n", "docs", "size"],
        )


def normaliser(n: int, documents: int, terms: int) -> int:
    return 100 - 90 + (90 * n * documents) // terms


def _normalised(documents: int, terms: int):
    """(m, doc_id, text) of the texts with terms."""

    def rows(batches):
        for batch in batches:
            n = _counts(batch.column("text"))
            keep = np.flatnonzero(n)
            known, back = np.unique(n[keep], return_inverse=True)
            m = np.array([normaliser(x, documents, terms) for x in known.tolist()], dtype=np.int64)[back]
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([pa.array(m), batch.column("doc_id").take(take), batch.column("text").take(take)], names=["m", "doc_id", "text"])

    return rows


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _cell(m: int, ids: pa.Array, texts: pa.Array) -> dict:
    """The inverted index of some documents of one stratum; ordinals follow doc_id, null last."""
    order = pc.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    raw, at = C.text_bytes(texts)
    folded = C.TERMS[raw]
    begin, end, first = C.word_spans(folded, at)
    word = C.span_hashes(folded, begin, end)
    doc = np.repeat(np.arange(len(ids)), np.diff(first))
    by = np.lexsort((doc, word))
    h, d = word[by], doc[by]
    pair = _starts(h, d)
    tf = np.diff(np.append(pair, len(h)))
    h, d, some = h[pair], d[pair], by[pair]
    by = np.lexsort((d, -tf, h))
    h, d, tf, some = h[by], d[by], tf[by], some[by]
    term, run = _starts(h), _starts(h, tf)
    size = (end - begin)[some[term]]
    letters = folded[C.ragged(begin[some[term]], size)]
    words = pa.StringArray.from_buffers(len(term), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(letters))
    return {
        "m": m, "ids": ids, "terms": words,
        "df": np.diff(np.append(term, len(h))).astype(np.int32), "top": tf[term].astype(np.int32), "hashes": h[term],
        "run_at": np.append(np.searchsorted(run, term), len(run)).astype(np.int32), "run_tf": tf[run].astype(np.int32),
        "post_at": np.append(run, len(h)).astype(np.int32), "posts": d.astype(np.int32),
    }


def _cells(docs: int, size: int):
    """Cells of texts that come sorted by (m, part), cut at ``docs`` texts or ``size`` bytes."""

    def one(m: int, held: list[pa.RecordBatch]):
        c = _cell(m, *(pa.concat_arrays([b.column(k) for b in held]) for k in ("doc_id", "text")))
        lists = [pa.array([c["m"]], pa.int64())]
        for name, kind in (("ids", pa.int64()), ("terms", pa.string()), ("df", pa.int32()), ("top", pa.int32())):
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(c[name])], pa.int32()), pa.array(c[name], kind) if name in ("df", "top") else c[name]))
        blobs = [pa.array([c[name].tobytes()], pa.binary()) for name in ("hashes", "run_at", "run_tf", "post_at", "posts")]
        return pa.RecordBatch.from_arrays([*lists, *blobs], names=[x.split()[0] for x in _CELL.split(", ")])

    def rows(batches):
        key, held, n, weight = None, [], 0, 0
        for batch in batches:
            keys = list(zip(batch.column("m").to_pylist(), batch.column("part").to_pylist(), strict=True))
            sizes, start = pc.binary_length(batch.column("text")).to_pylist(), 0
            for i, own in enumerate(keys):
                if own != key or n == docs or weight + sizes[i] > size:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield one(key[0], held)
                    key, held, n, weight, start = own, [], 0, 0, i
                n, weight = n + 1, weight + sizes[i]
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield one(key[0], held)

    return rows


def build(docs: DataFrame, cell: int = CELL, cell_bytes: int = CELL_BYTES) -> Index:
    """The index of all rows of ``docs`` (doc_id, text) that have a term; N and L count them all."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lengths = texts.select("text").mapInArrow(_lengths, "n long, docs long, size long").groupBy("n").agg(F.sum("docs").alias("docs"), F.sum("size").alias("size"))
    lengths = C.stage(lengths.where("n > 0"), "lengths")
    total = lengths.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    documents, terms = int(total[0] or 0), int(total[1] or 0)
    m = F.lit(100 - 90) + F.expr(f"(90L * n * {documents}L) div {max(terms, 1)}L")
    strata = C.stage(lengths.groupBy(m.alias("m")).agg(F.sum("docs").alias("docs"), F.sum("size").alias("size")), "strata")
    parts = strata.select("m", F.greatest(F.ceil(F.col("docs") / cell), F.ceil(F.col("size") / cell_bytes)).alias("parts"))
    sized = texts.mapInArrow(_normalised(documents, max(terms, 1)), "m long, doc_id long, text string")
    dealt = sized.join(parts, "m").select("m", F.pmod(F.xxhash64("doc_id", "text"), "parts").alias("part"), "doc_id", "text")
    cells = dealt.repartition("m", "part").sortWithinPartitions("m", "part").mapInArrow(_cells(cell, cell_bytes), _CELL)
    return Index(C.stage(cells, "cells"), strata.select("m", "docs"), documents, terms)


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def rows(batches):
        for batch in batches:
            for a, b, raw, at in C.text_chunks(batch.column("text")):
                folded = C.TERMS[raw]
                begin, end, first = C.word_spans(folded, at)
                bounds = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
                words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(bounds), pa.py_buffer(folded[C.ragged(begin, end - begin)]))
                item = batch.column("item_id").take(pa.array(np.repeat(np.arange(a, b), np.diff(first))))
                yield pa.RecordBatch.from_arrays([item, words], names=["item_id", "term"])

    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    return named.mapInArrow(rows, "item_id long, term string").distinct()


def _impact(tf: str):
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 8L * m)")


class _Cell:
    """A cell's row as arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        value = lambda name: batch.column(name)[row]
        read = lambda name, kind: np.frombuffer(value(name).as_py(), dtype=kind)
        self.m, self.ids, self.words = value("m").as_py(), value("ids").values, value("terms").values
        self.top = value("top").values.to_numpy().astype(np.int64)
        self.hashes = read("hashes", np.uint64)
        self.run_at, self.post_at, self.posts = (read(n, np.int32).astype(np.int64) for n in ("run_at", "post_at", "posts"))
        tf = read("run_tf", np.int32).astype(np.int64)
        self.run_impact = self.impact(tf)

    def impact(self, tf: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 8 * self.m)

    def places(self, words: pa.Array) -> np.ndarray:
        """The number of each word in the cell's dictionary; -1 if it is not there."""
        if not len(words) or not len(self.hashes):
            return np.full(len(words), -1)
        raw, at = C.text_bytes(words)
        asked = C.span_hashes(raw, at[:-1], at[1:])
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        same = (self.hashes[at] == asked) & pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)

    def scores(self, item: np.ndarray, word: np.ndarray, weight: np.ndarray, items: int):
        """(items numbered from ``low``, sums of all documents) for runs of items; entries come sorted by item."""
        runs = self.run_at[word + 1] - self.run_at[word]
        run = C.ragged(self.run_at[word], runs)
        item, weight = np.repeat(item, runs), np.repeat(weight, runs)
        value, many = weight * self.run_impact[run], self.post_at[run + 1] - self.post_at[run]
        bounds = np.searchsorted(item, np.arange(items + 1))
        held = np.concatenate(([0], np.cumsum(many)))[bounds]
        low = 0
        while low < items:
            high = low + 1
            while high < items and held[high + 1] - held[low] <= _SPAN and (high + 1 - low) * len(self.ids) <= _SPAN:
                high += 1
            own = slice(bounds[low], bounds[high])
            at = np.repeat((item[own] - low) * len(self.ids), many[own]) + self.posts[C.ragged(self.post_at[run[own]], many[own])]
            values, size = np.repeat(value[own], many[own]), (high - low) * len(self.ids)
            if float(value[own].max(initial=0)) * max(1, own.stop - own.start) < 2**52:
                sums = np.bincount(at, weights=values, minlength=size).astype(np.int64)
            else:
                sums = np.zeros(size, np.int64)
                np.add.at(sums, at, values)
            yield low, sums.reshape(high - low, len(self.ids))
            low = high


def _best(sums: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k best of each row that reach its floor, best first; ties to the earlier place."""
    cut = np.maximum(floor, 1)
    if sums.shape[1] > k:
        cut = np.maximum(cut, np.partition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k])
    row, place = np.nonzero(sums >= cut[:, None])
    by = np.lexsort((place, -sums[row, place], row))
    row, place = row[by], place[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], place[rank < k]


def _score(k: int):
    """(item_id, doc_id, score): the k best of each visiting item in each cell, unless its floor rules them out."""

    def rows(batches):
        seen: dict[int, list[int]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                cell = _Cell(batch, r)
                ids, bars = (x.to_numpy() for x in batch.column("bars")[r].values.flatten())
                by = np.argsort(ids)
                ids, bars = ids[by], bars[by]
                floor = np.array([max(bar, seen[i][0] if len(seen.get(i, ())) == k else 1) for i, bar in zip(ids.tolist(), bars.tolist(), strict=True)])
                asked, words, weight = batch.column("asked")[r].values.flatten()
                word = cell.places(words)
                asked, weight = asked.to_numpy(), weight.to_numpy()
                item = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
                keep = (word >= 0) & (ids[item] == asked)
                item, word, weight = item[keep], word[keep], weight[keep]
                bound = np.zeros(len(ids), np.int64)
                np.add.at(bound, item, weight * cell.impact(cell.top[word]))
                live = np.flatnonzero(bound >= floor)
                keep = np.isin(item, live)
                item, word, weight = np.searchsorted(live, item[keep]), word[keep], weight[keep]
                by = np.argsort(item, kind="stable")
                for low, sums in cell.scores(item[by], word[by], weight[by], len(live)):
                    some = live[low : low + len(sums)]
                    row, place = _best(sums, floor[some], k)
                    if not len(row):
                        continue
                    score = sums[row, place]
                    for i, s in zip(ids[some[row]].tolist(), score.tolist(), strict=True):
                        own = seen.setdefault(i, [])
                        if len(own) < k:
                            heapq.heappush(own, s)
                        else:
                            heapq.heappushpop(own, s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some[row]]), cell.ids.take(pa.array(place)), pa.array(score)], names=["item_id", "doc_id", "score"]
                    )

    return rows


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 10, first: int = FIRST, group: int = GROUP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` highest scores above 0.

    Terms of rows of one item_id count as one item; rows without item_id or text ask
    nothing. Equal scores go to the smaller doc_id, documents without doc_id come last;
    every row of documents is ranked, also one that repeats another. Other columns are
    ignored. Scores are exact while they fit a long.
    """
    asked = C.stage(terms_of(items), "asked")
    entry = F.explode(F.arrays_zip("terms", "df", "top")).alias("t")
    tops = index.cells.select("m", entry).select("m", F.col("t.terms").alias("term"), F.col("t.df").alias("df"), F.col("t.top").alias("top"))
    tops = tops.join(asked.select("term").distinct(), "term").groupBy("m", "term").agg(F.sum("df").alias("df"), F.max("top").cast("long").alias("top"))
    tops = C.stage(tops, "tops")
    frequency = tops.groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1))).alias("w")
    weights = C.stage(asked.join(frequency, "term").select("item_id", "term", w), "weights")
    bounds = weights.join(tops, "term").groupBy("item_id", "m").agg(F.sum(F.col("w") * _impact("top")).alias("bound")).where("bound > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    bounds = C.stage(bounds.join(index.strata, "m").withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0))), "bounds")
    blocks = max(1, -(-weights.select("item_id").distinct().count() // group))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")
    questions = C.stage(weights.groupBy(block).agg(F.collect_list(F.struct("item_id", "term", "w")).alias("asked")), "questions")

    def visit(visits: DataFrame) -> DataFrame:
        # As a written table its size is known: while it is small, the index stays where it is.
        callers = C.stage(visits.groupBy("m", block).agg(F.collect_list(F.struct("item_id", "bar")).alias("bars")), "callers")
        met = index.cells.join(callers, "m").join(questions, "block")
        return met.mapInArrow(_score(k), "item_id long, doc_id long, score long")

    early = F.col("before") < first
    found = C.stage(_top(visit(bounds.where(early).withColumn("bar", F.lit(1).cast("long"))), k), "first")
    bars = found.where(F.col("rank") == k).select("item_id", F.col("score").alias("bar"))
    late = bounds.where(~early).join(bars, "item_id", "left").withColumn("bar", F.coalesce("bar", F.lit(1))).where("bound >= bar")
    every = found.select("item_id", "doc_id", "score").union(visit(late))
    return _top(every, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` of ``items`` (item_id, text) over a fresh index of ``docs`` (doc_id, text)."""
    return search(build(docs), items, k)
