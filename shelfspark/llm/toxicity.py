"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are byte 5-grams of the folded text that stay within one word and its borders. A chi-square test on a bounded sample of
labelled rows picks those that tell the classes apart, all of them; their document frequencies are
counted over all documents. The examples (bounded, from the same sample) stand in blocks
of 64; the index holds for each term the blocks it occurs in, with the largest weight there and
the postings (example, weight). A text's bound on a block is the sum
of its weights times these maxima; blocks are scored from the best bound down until no
bound reaches the k-th similarity, so the neighbours are exact. Their votes, weighted by
similarity and corrected for how many of each class were sampled, are calibrated on the
examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import common as C
from shelfspark.llm.language_id import _chunks, _grams

GRAM = 5
BLOCK = 64
#: Chi-square with one degree of freedom: a chance of about 1e-7.
LEAST_CHI = 28.0


def _inside(raw: np.ndarray, at: np.ndarray, place: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether the gram at each place lies in its text and crosses no word border but at its ends."""
    good = place + GRAM <= at[text + 1]
    for i in range(1, GRAM - 1):
        good &= raw[np.minimum(place + i, len(raw) - 1)] != 32
    return good


def _term_counts(batches):
    """(gram, texts, toxic texts) of each run of sample texts."""
    for batch in batches:
        marks = batch.column("toxic").to_numpy().astype(np.int64)
        for a, b, raw, at in _chunks(batch.column("text").to_pylist()):
            grams = _grams(raw, GRAM)
            text = np.searchsorted(at, np.arange(len(grams)), "right") - 1
            whole = _inside(raw, at, np.arange(len(grams)), text)
            pair = np.unique((text[whole].astype(np.uint64) << C.U64(44)) | grams[whole])
            gram, inverse = np.unique(pair & C.U64((1 << 44) - 1), return_inverse=True)
            toxic = np.bincount(inverse, weights=marks[a:b][(pair >> C.U64(44)).astype(np.int64)], minlength=len(gram))
            yield pa.RecordBatch.from_arrays(
                [pa.array(C.signed(gram)), pa.array(np.bincount(inverse, minlength=len(gram))), pa.array(toxic.astype(np.int64))],
                names=["gram", "n", "toxic"],
            )


class Terms:
    """Finds the chosen grams in texts: a small table first, then a search."""

    BITS = 18

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(np.uint64))
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[self._slot(self.grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * C.U64(0x9E3779B97F4A7C15)) >> C.U64(64 - self.BITS)).astype(np.int64)

    def counts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times), sorted by text and term."""
        grams = _grams(raw, GRAM)
        place = np.flatnonzero(self.maybe[self._slot(grams)])
        term = np.searchsorted(self.grams, grams[place])
        real = term < len(self.grams)
        real[real] = self.grams[term[real]] == grams[place][real]
        place, term = place[real], term[real]
        text = np.searchsorted(at, place, "right") - 1
        inside = _inside(raw, at, place, text)
        key, times = np.unique(text[inside] * len(self.grams) + term[inside] if len(self.grams) else text[:0], return_counts=True)
        width = max(1, len(self.grams))
        return key // width, key % width, times


def _vectors(model):
    def rows(batches):
        terms = model.value
        for batch in batches:
            for a, b, raw, at in _chunks(batch.column("text").to_pylist()):
                text, term, times = terms.counts(raw, at)
                bounds = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in ("did", "rk", "doc_id", "held_out")),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
                    ],
                    names=["did", "rk", "doc_id", "held_out", "terms", "times"],
                )

    return rows


def _document_counts(width: int):
    """(term, texts) of all rows of a task, at most one row a term."""

    def rows(batches):
        n = np.zeros(width, dtype=np.int64)
        for batch in batches:
            n += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(n[term])], names=["t", "n"])

    return rows


class Index:
    """Examples as unit vectors in posting lists, cut in blocks with their largest weights."""

    def __init__(self, terms: int, idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]], weights: tuple[float, float], prior: float, empty: float, k: int):
        self.idf, self.prior, self.empty, self.k = idf, prior, empty, k
        examples = sorted(examples, key=lambda e: e[0])
        self.ids = np.array([e[0] for e in examples], dtype=np.int64)
        self.labels = np.array([e[1] for e in examples], dtype=np.float64)
        self.weights = np.where(self.labels > 0, weights[1], weights[0])
        self.width = max(1, terms)
        own = [np.array(e[2], dtype=np.int64) for e in examples]
        #: Terms and weights of each example, for its own vote.
        self.rows = [(t, self.unit(t, np.array(e[3]))) for t, e in zip(own, examples, strict=True)]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in self.rows)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in self.rows)])
        place = np.repeat(np.arange(len(own)), [len(t) for t in own])
        order = np.lexsort((place, term))
        term, self.post_place, self.post_weight = term[order], place[order], weight[order]
        block = self.post_place // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        #: An entry is a term in a block: its postings are those from post_at[e] to post_at[e + 1].
        self.post_at = np.append(first, len(term))
        self.entry_block = block[first]
        self.entry_most = np.maximum.reduceat(self.post_weight, first) if len(first) else np.zeros(0)
        self.entry_at = np.searchsorted(term[first], np.arange(self.width + 1))
        self.slope, self.shift = 1.0, 0.0
        self._calibrate()

    @property
    def vectors(self) -> np.ndarray:
        """The examples as one dense matrix, for small indexes."""
        out = np.zeros((len(self.rows), self.width))
        for i, (terms, weights) in enumerate(self.rows):
            out[i, terms] = weights
        return out

    def unit(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(times)) * self.idf[terms]
        return w / max(np.sqrt((w * w).sum()), 1e-12)

    def neighbours(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the ``k`` nearest examples (above 0; ties: the smaller id)."""
        n = self.entry_at[terms + 1] - self.entry_at[terms]
        entry, share = C.ragged(self.entry_at[terms], n), np.repeat(weights, n)
        order = np.argsort(self.entry_block[entry], kind="stable")
        entry, share = entry[order], share[order]
        block = self.entry_block[entry]
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        end = np.append(begin[1:], len(block))
        bound = np.add.reduceat(share * self.entry_most[entry], begin) if len(begin) else np.zeros(0)
        places, sims = np.zeros(0, np.int64), np.zeros(0)
        rank, at, wave = np.argsort(-bound, kind="stable"), 0, 2
        while at < len(rank):
            blocks = rank[at : at + wave]
            # A hair of slack, so that rounding of the bound cannot hide an equal similarity.
            if len(sims) == k:
                blocks = blocks[bound[blocks] >= sims[-1] - 1e-12]
            if not len(blocks):
                break
            at, wave = at + len(blocks), 2 * wave
            own = C.ragged(begin[blocks], end[blocks] - begin[blocks])
            count = self.post_at[entry[own] + 1] - self.post_at[entry[own]]
            post = C.ragged(self.post_at[entry[own]], count)
            sim = np.bincount(self.post_place[post], self.post_weight[post] * np.repeat(share[own], count), len(self.ids))
            hit = np.flatnonzero(sim > 0)
            places = np.concatenate([places, hit])
            sims = np.concatenate([sims, sim[hit]])
            best = np.lexsort((places, -sims))[:k]
            places, sims = places[best], sims[best]
        return places, sims

    def vote(self, places: np.ndarray, sims: np.ndarray) -> float:
        """Share of toxic weight, near neighbours counting more, with one vote for the prior."""
        w = sims**2 * self.weights[places]
        floor = min(self.weights.min(initial=1.0), 1.0)
        return float(((w * self.labels[places]).sum() + floor * self.prior) / (w.sum() + floor))

    def score(self, terms: np.ndarray, times: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(terms) or not len(self.ids):
            return self.empty, np.zeros(0, np.int64), np.zeros(0)
        places, sims = self.neighbours(terms, self.unit(terms, times), self.k)
        v = self.vote(places, sims)
        return float(1 / (1 + np.exp(-(self.slope * _logit(v) + self.shift)))), places, sims

    def _calibrate(self) -> None:
        """Logistic fit of label on the logit of the vote, every example without itself."""
        if len(set(self.labels.tolist())) < 2:
            return
        votes = []
        for i in range(len(self.ids)):
            places, sims = self.neighbours(*self.rows[i], self.k + 1)
            other = places != i
            votes.append(self.vote(places[other][: self.k], sims[other][: self.k]))
        x = np.stack([_logit(np.array(votes)), np.ones(len(votes))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            r = self.weights / self.weights.mean()
            pull = np.diag([1.0, 0.1])
            grad = x.T @ (r * (p - self.labels)) + pull @ (w - np.array([1.0, 0.0]))
            hess = (x * (r * p * (1 - p))[:, None]).T @ x + pull
            w = w - np.linalg.solve(hess, grad)
        self.slope, self.shift = max(0.05, float(w[0])), float(w[1])


def _logit(v):
    v = np.clip(v, 1e-6, 1 - 1e-6)
    return np.log(v / (1 - v))


def _score(model):
    def rows(batches):
        index = model.value
        for batch in batches:
            terms, times = batch.column("terms"), batch.column("times")
            bounds = np.asarray(terms.offsets)
            term_of, times_of = terms.values.to_numpy(), times.values.to_numpy()
            known: dict[bytes, tuple] = {}
            scores, near, sims = [], [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                key = term_of[a:b].tobytes() + times_of[a:b].tobytes()
                if key not in known:
                    s, places, own = index.score(term_of[a:b], times_of[a:b])
                    known[key] = s, index.ids[places[:3]].tolist(), own[:3].tolist()
                s, ids, own = known[key]
                scores.append(s)
                near.append(ids)
                sims.append(own)
            p = np.array(scores, dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("did", "rk", "doc_id", "held_out")), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                    pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64())),
                ],
                names=["did", "rk", "doc_id", "held_out", "score", "predicted", "nearest", "similarity"],
            )

    return rows


def _sample(labels: DataFrame, folds: int, per_class: int) -> DataFrame:
    """(doc_id, toxic) of at most ``per_class`` training labels of each class, those of lowest hash."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (C.fold_in(F.col("doc_id"), folds) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    return C.hash_sample(known, "toxic", ["doc_id"], per_class)


def _rows_scored(docs: DataFrame, labels: DataFrame, folds: int, per_class: int, examples: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    base = C.documents_of(docs).select(*C.row_key(), "doc_id", (C.fold_in(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    sample = C.stage(_sample(labels, folds, per_class), "sample")
    # At most per_class rows of two small values for each of two classes.
    taught = base.where("text is not null").join(F.broadcast(sample), "doc_id")
    sizes = {r[0]: r[1] for r in taught.groupBy("toxic").count().collect()}
    n_all, n_bad = float(sum(sizes.values())), float(sizes.get(1, 0))
    counts = taught.select("text", "toxic").mapInArrow(_term_counts, "gram long, n long, toxic long").groupBy("gram").agg(
        F.sum("n").cast("double").alias("n"), F.sum("toxic").cast("double").alias("bad")
    )
    # N (ad - bc)^2 / (product of the margins), from counts of texts.
    apart = F.col("bad") * n_all - F.col("n") * n_bad
    chi = apart * apart * n_all / (F.col("n") * (n_all - F.col("n") + 1e-9) * float(max(1, n_bad)) * max(1, n_all - n_bad))
    least = max(3, int(n_all) // 2000)
    best = counts.where(F.col("n") >= least).select("gram", chi.alias("chi"))
    # As many as differ in a sample of 2 x per_class texts, whatever the table's size.
    # Here and below whole texts go to Python: in batches of bounded size.
    with C.small_batches(spark):
        grams = np.array([r[0] for r in best.where(F.col("chi") >= LEAST_CHI).orderBy("gram").collect()], dtype=np.int64)
    terms = Terms(grams.view(np.uint64))
    kinds = "did long, rk int, doc_id long, held_out boolean, terms array<int>, times array<int>"
    with C.small_batches(spark):
        vectors = C.stage(base.mapInArrow(_vectors(share(terms)), kinds), "vectors")
    total = vectors.count()
    df = np.zeros(max(1, len(grams)))
    for r in vectors.select("terms").mapInArrow(_document_counts(len(df)), "t int, n long").groupBy("t").agg(F.sum("n")).collect():  # one row a term
        df[r[0]] = r[1]
    labelled = C.stage(vectors.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "did", "rk", "terms", "times"), "labelled")
    seen = {(r[0], r[1]): r[2] for r in labelled.groupBy("toxic", F.size("terms") == 0).count().collect()}
    chosen = C.hash_sample(labelled.where(F.size("terms") > 0), "toxic", ["doc_id", "rk"], examples)
    held = [(r.doc_id, r.toxic, r.terms, r.times) for r in chosen.collect()]  # at most 2 x examples rows
    # Labels of the whole training set give the true class sizes that the sample's votes are corrected to.
    truth = labels.where(F.col("doc_id").isNotNull() & (C.fold_in(F.col("doc_id"), folds) != 0)).groupBy(F.col("toxic").cast("int").alias("y")).count()
    size = {r[0]: r[1] for r in truth.collect() if r[0] in (0, 1)}
    rate = {y: size.get(y, 0) / max(1, sizes.get(y, 0)) for y in (0, 1)}
    full = {y: (seen.get((y, False), 0)) * rate[y] for y in (0, 1)}
    bare = {y: (seen.get((y, True), 0)) * rate[y] for y in (0, 1)}
    picked = {y: sum(e[1] == y for e in held) for y in (0, 1)}
    weights = tuple(full[y] / max(1, picked[y]) / max(1e-9, max(full.values())) * max(1, max(picked.values())) for y in (0, 1))
    prior = (full[1] + 0.5) / (full[0] + full[1] + 1)
    empty = (bare[1] + 0.5) / (bare[0] + bare[1] + 2)
    index = Index(len(grams), np.log((total + 1) / (df + 1)) + 1, held, weights, prior, empty, k)
    return vectors.mapInArrow(
        _score(share(index)), "did long, rk int, doc_id long, held_out boolean, score double, predicted int, nearest array<long>, similarity array<double>"
    )


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = 6000, examples: int = 2048, k: int = 15) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted, and the three nearest examples of every row.

    Learns only from labels whose crc32(doc_id) modulo ``folds`` is not 0, from at most
    ``per_class`` labelled texts of each class (lowest hash) for the choice of terms and
    ``examples`` of each as neighbours. A doc_id labelled twice is toxic if any label says
    so; labels that are null or neither 0 nor 1 teach nothing. Texts without any chosen
    term, null and empty ones too, get the rate of toxic ones among such labelled texts.
    Rows without doc_id count as held out; repeated rows are scored each; other columns are
    ignored.
    """
    rows = _rows_scored(docs, labels, folds, per_class, examples, k)
    return rows.select("doc_id", "held_out", "score", "predicted", "nearest", "similarity")


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` does not predict toxic.

    Null and empty texts and texts without a known term get the score of an empty text;
    repeated rows stay or go together, rows without doc_id are told apart by text; without
    labels of both classes, or without rows, all rows stay.
    """
    settings = {"folds": 5, "per_class": 6000, "examples": 2048, "k": 15} | options
    bad = _rows_scored(docs, labels, **settings).where("predicted = 1").select(F.col("did").alias("_did"), F.col("rk").alias("_rk"))
    keyed = docs.withColumns(dict(zip(("_did", "_rk"), C.row_key(), strict=True)))
    return keyed.join(bad.distinct(), ["_did", "_rk"], "left_anti").select(docs.columns)
