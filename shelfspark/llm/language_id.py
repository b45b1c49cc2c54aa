"""Language identification by bit-sliced Bloom filters over byte n-grams.

One slot of the filter holds a bit per language, so a look-up returns, for all
languages at once, whether the n-gram may occur in them: the bitwise and of ``HASHES``
slots. A text's language counts are the popcounts of these answers by language, less
what the filter's false positives add on average: (c - n f) / (1 - f).

The model is fitted on a bounded sample (``per_language`` labelled texts of each
language, chosen by hash) and is at most ``SLOTS`` x languages / 8 bytes; texts are scored
in one narrow stage without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import common as C

#: Byte lengths of the n-grams.
GRAMS = (3, 5)
SLOTS = 1 << 21
HASHES = 3
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _folded(text: str | None) -> bytes:
    """Lower case, with every ASCII character that is no letter as a space."""
    if not text:
        return b"  "
    if not text.isascii():
        text = text.lower()
    return b" " + text.encode("utf-8", "surrogatepass").translate(_FOLD) + b" "


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that starts at each byte, packed into an integer with its length on top."""
    wide = raw.astype(np.uint64)
    out = np.full(max(0, len(raw) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = (out << C.U64(8)) | wide[i : len(wide) - n + 1 + i]
    return out


def _chunks(texts: list[str | None], size: int = 1 << 19):
    """(first, last, bytes, bounds) over folded texts."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(_folded(text))
        total += len(held[-1])
        if total >= size or i == len(texts) - 1:
            at = np.concatenate(([0], np.cumsum([len(x) for x in held])))
            yield first, i + 1, np.frombuffer(b"".join(held), dtype=np.uint8), at
            first, held, total = i + 1, [], 0


def _counts(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for code in sorted(set(langs)):
            texts = [t for t, x in zip(batch.column("text").to_pylist(), langs, strict=True) if x == code]
            for _, _, raw, _ in _chunks(texts):
                for n in GRAMS:
                    gram, times = np.unique(_grams(raw, n), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([code] * len(gram)), pa.array([n] * len(gram), pa.int32()), pa.array(C.signed(gram)), pa.array(times)],
                        names=["lang", "n", "gram", "times"],
                    )


class Filter:
    """The bit-sliced filter: ``table[slot]`` has a bit for each language."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray]):
        self.languages = languages
        self.words = max(1, -(-len(languages) // 64))
        kind = next(t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(languages) <= n)
        self.table = np.zeros((self.words, SLOTS), dtype=kind)
        rates = []
        for i, code in enumerate(languages):
            own = np.zeros(SLOTS, dtype=bool)
            for slot in self.slots(grams[code]):
                own[slot] = True
            self.table[i // 64][own] |= kind(1 << (i % 64))
            rates.append(own.mean() ** HASHES)
        self.rates = np.array(rates)

    @staticmethod
    def slots(grams: np.ndarray) -> list[np.ndarray]:
        h = C.mix(grams)
        return [((h >> C.U64(21 * i)) & C.U64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each word of languages, the languages that may hold each n-gram."""
        slots = self.slots(grams)
        out = []
        for word in self.table:
            mask = word[slots[0]]
            for slot in slots[1:]:
                mask &= word[slot]
            out.append(mask)
        return out

    def known(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages): corrected numbers of n-grams known in each language."""
        total = np.zeros((len(at) - 1, len(self.languages)))
        for n in GRAMS:
            grams = _grams(raw, n)
            if not len(grams):
                continue
            start = np.minimum(at[:-1], len(grams))
            end = np.maximum(start, np.minimum(at[1:] - n + 1, len(grams)))
            for w, mask in enumerate(self.masks(grams)):
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    sums = np.concatenate(([0], np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), dtype=np.int64)))
                    size = end - start
                    f = self.rates[i]
                    total[:, i] += np.maximum(0, (sums[end] - sums[start] - size * f) / (1 - f)) if f < 1 else 0
        return total


def fit(docs: DataFrame, train: Column, per_language: int = 1500, grams: int = 30_000, foreign: float = 0.2) -> Filter:
    """A filter from at most ``per_language`` texts of each language among the ``train`` rows.

    The texts are those of lowest hash; a language keeps its ``grams`` commonest n-grams of
    each length, less those whose share of its text is under ``foreign`` times their share
    in the language that uses them most (stray passages of another language). Rows with null text, null lang or an empty lang teach nothing.
    """
    base = docs.where(train & F.col("text").isNotNull() & (F.length("lang") > 0))
    keyed = base.select(F.col("lang").cast("string").alias("lang"), *C.row_key(), "text")
    picked = C.hash_sample(keyed.select("lang", "did", "rk").distinct(), "lang", ["did", "rk"], per_language)
    # At most per_language rows of three small values for each language.
    sample = keyed.join(F.broadcast(picked), ["lang", "did", "rk"]).dropDuplicates(["lang", "did", "rk"])
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, n int, gram long, times long")
    common = Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram")
    share = F.col("times") / F.sum("times").over(Window.partitionBy("lang", "n"))
    best = (
        counts.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
        .withColumn("_share", share)
        .where(F.col("times") > 1)
        .withColumn("_most", F.max("_share").over(Window.partitionBy("n", "gram")))
        .where(F.col("_share") >= foreign * F.col("_most"))
        .withColumn("_n", F.row_number().over(common)).where(F.col("_n") <= grams)
        .select("lang", "gram")
    ).toPandas()
    languages = sorted(best["lang"].unique())
    return Filter(languages, {x: best.loc[best["lang"] == x, "gram"].to_numpy().view(np.uint64) for x in languages})


def _predict(model):
    def rows(batches):
        held = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names: list[str] = []
            scores: list[float] = []
            for a, b, raw, at in _chunks(texts):
                known = held.known(raw, at)
                best = known.argmax(axis=1) if known.shape[1] else np.zeros(b - a, int)
                share = known.max(axis=1, initial=0) / np.maximum(known.sum(axis=1), 1e-12)
                for text, i, x in zip(texts[a:b], best, share, strict=True):
                    lettered = bool(held.languages) and text is not None and _LETTER.search(text) is not None
                    names.append(held.languages[i] if lettered else "und")
                    scores.append(float(min(1.0, x)) if lettered else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows


def identify(docs: DataFrame, folds: int = 3, held: int = 1, per_language: int = 1500, grams: int = 30_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text.

    Learns from rows whose crc32(doc_id) modulo ``folds`` is not ``held``; rows without
    doc_id count as remainder 0. lang_pred is ``und`` with score 0 where the text is null
    or has no letter, or nothing could be learned. score is the language's share of the
    corrected counts. Ties go to the first language by name. Repeated rows are predicted
    each; other columns are ignored.
    """
    rows = C.documents_of(docs, "lang").withColumn("held_out", C.fold_in(F.col("doc_id"), folds) == held)
    model = fit(rows, ~F.col("held_out"), per_language, grams)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
