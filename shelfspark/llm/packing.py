"""Best-fit packing by exact-complement hashing.

Texts become token ids, end with id 0, and only those longer than a sequence are cut. All
planning happens on the counts of the piece lengths: at most ``capacity`` numbers, however
many pieces there are. Lengths are taken from the longest down. The gap that one leaves is
looked up in an index of single lengths, sums of two and sums of three; a combination that fills it
exactly is used as often as its counts allow, in one step. What has no exact complement is
packed best-fit, longest first, into the smallest gap that takes it.

The plan says, for each length, which ranks go to which sequences and offsets. Pieces get
their rank within a length from counts of (length, salt) and a row number inside each, so
that no length gathers in one task, and meet the plan as a bounded broadcast.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import common as C

CAPACITY = 2048
#: Pieces of one length that are numbered together, about.
SALT_ROWS = 1_000

#: Marks of ASCII. Behind letters they are a piece of their own to the tokenizer.
MARKS = string.punctuation
#: Bytes of texts that are encoded together, about.
SLICE = 4 << 20


def _lettered(word: bytes) -> bool:
    """Whether the tokenizer sees one run of letters: also after its own lower-casing."""
    if word.isalpha():
        return True
    if word.isascii():
        return False
    text = unicodedata.normalize("NFC", word.decode("utf-8", "replace"))
    return text.isalpha() and text.lower().isalpha()


def _folded(words: pa.StringArray) -> pa.StringArray:
    """``words`` with A-Z lower-cased in those of ASCII, as the tokenizer would."""
    # It finds its special tokens before it folds case.
    folds = pc.and_not(pc.string_is_ascii(words), pc.match_substring(words, "<|"))
    return pc.if_else(folds, pc.ascii_lower(words), words)


class Words:
    """Token ids of words by a tokenizer whose splits never cross ASCII white space.

    Letters with ASCII marks behind them are two pieces to the tokenizer, so both halves are
    kept, not the word. Each is encoded once and kept until ``limit`` are known; then those met
    again since the last time stay, if they are not more than half of ``limit``.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in vocab.items():
            self.last[i] = token.endswith("</w>")
        # a-z need no normalizing: the model alone gives the same ids, if it does for words of the vocabulary.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = sorted(x for t in vocab if (x := t.removesuffix("</w>").encode()).isalpha() and x.islower())
        if not np.array_equal(*(self._ids(t, letters[::40]) for t in (self.plain, self.tokenizer))):
            self.plain = self.tokenizer
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int64)
        #: Whether marks behind it are a piece of their own; whether it was met again.
        self.apart = np.zeros(1 << 16, dtype=bool)
        self.met = np.zeros(1 << 16, dtype=bool)
        self.filled = 0
        self._put([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64), True)

    def _thin(self) -> None:
        """Keep what was met again; nothing, if that is too much."""
        kept = self.met[: len(self.known)].copy()
        kept[0] = False  # the empty word is there anyhow
        at = np.flatnonzero(kept)
        words, ids, size, apart = list(compress(self.known, kept.tolist())), self._all(at), self.size[at], self.apart[at]
        self._clear()
        if 2 * len(words) <= self.limit:
            self._put(words, ids, size, apart)

    def _put(self, words: list[bytes], ids: np.ndarray, size: np.ndarray, apart: np.ndarray | bool) -> None:
        """Keep ``words`` with their ids, which stand one after the other."""
        first, last = len(self.known), len(self.known) + len(words)
        while self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while last > len(self.start):
            self.start, self.size, self.apart, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.apart, self.met))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.size[first:last] = size
        self.start[first:last] = self.filled + np.cumsum(size) - size
        self.apart[first:last] = apart
        self.known.update(zip(words, range(first, last), strict=True))
        self.filled += len(ids)

    def _all(self, at: np.ndarray) -> np.ndarray:
        """The ids of what stands ``at`` there, one after the other."""
        return self.ids[C.ragged(self.start[at], self.size[at])]

    @staticmethod
    def _ids(tokenizer, words: list[bytes]) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        """Encode ``words``, none of them known.

        Words of letters go through the tokenizer together, as the ids of one end where an id
        carries the tokenizer's word-end mark; all others go one by one.
        """
        plain = [w for w in words if w.isalpha()]
        beyond = [w for w in words if not w.isascii() and _lettered(w)]
        for tokenizer, own, folded in ((self.plain, plain, [w.lower() for w in plain]), (self.tokenizer, beyond, beyond)):
            ids = self._ids(tokenizer, folded)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own):
                self._put(own, ids, np.diff(ends, prepend=0), True)
        rest = [w for w in words if w not in self.known]
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)]
            size = np.array([len(x) for x in found])
            self._put(rest, np.array([x for own in found for x in own], dtype=np.uint32), size, np.array([_lettered(w) for w in rest]))

    def _at(self, words: pa.StringArray) -> np.ndarray:
        """Where the ids of each of ``words`` stand, as whole words."""
        coded = words.dictionary_encode()
        own = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, own, repeat(-1)), dtype=np.int64, count=len(own))
        missing = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = True
        if len(missing):
            new = [own[i] for i in missing.tolist()]
            self._learn(new)
            at[missing] = np.fromiter(map(self.known.__getitem__, new), dtype=np.int64, count=len(new))
        return at[coded.indices.to_numpy()]

    def _halves(self, words: pa.StringArray) -> np.ndarray:
        """Two places for each of ``words``: of what stands before its last marks, and of these."""
        heads = pc.ascii_rtrim(words, characters=MARKS)
        both = np.stack([self._at(heads), np.zeros(len(words), np.int64)], axis=1)
        size = pc.binary_length(heads).to_numpy()
        marked = size < pc.binary_length(words).to_numpy()
        apart = self.apart[both[:, 0]]
        whole, tailed = np.flatnonzero(marked & ~apart), np.flatnonzero(marked & apart)
        if len(whole):
            both[whole, 0] = self._at(words.take(pa.array(whole)))
        if len(tailed):
            ends = words.take(pa.array(tailed))
            # The same bytes, cut also where the heads end: every second one is the marks.
            start = np.frombuffer(ends.buffers()[1], dtype=np.int32, count=len(ends) + 1)
            cut = np.append(np.stack([start[:-1], start[:-1] + size[tailed]], axis=1).ravel(), start[-1]).astype(np.int32)
            cut = pa.StringArray.from_buffers(2 * len(ends), pa.py_buffer(cut), ends.buffers()[2])
            both[tailed, 1] = self._at(cut.take(pa.array(np.arange(1, 2 * len(ends), 2))))
        return both

    def encode(self, words: list[bytes] | pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``words`` in order, and the number of ids of each."""
        if isinstance(words, list):
            words = pa.array(words, pa.binary()).view(pa.string())
        if len(self.known) > self.limit:
            self._thin()
        coded = words.dictionary_encode()
        halves = self._halves(_folded(coded.dictionary))
        ids, size = self._all(halves.ravel()), self.size[halves].sum(axis=1)
        at = coded.indices.to_numpy()
        return ids[C.ragged((np.cumsum(size) - size)[at], size[at])], size[at]


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """The word table of this Python process: tasks that follow each other share it."""
    return Words(path)


def _words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Words of all texts, and the number of each text."""
    split = pc.ascii_split_whitespace(texts)
    return split.flatten(), pc.list_value_length(split).to_numpy()


def _piece_rows(path: str, capacity: int, with_ids: bool):
    def rows(batches):
        words = words_of(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            bytes_to = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
            first = 0
            while first < len(texts):
                before = int(bytes_to[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(bytes_to, before + SLICE, "right")))
                held, counts = _words(texts.slice(first, last - first))
                ids, size = words.encode(held)
                ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)]
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                begin = 0
                for i, end in enumerate(ends.tolist(), first):
                    own = np.append(ids[begin:end], np.uint32(0)).astype("<u4")
                    begin = end
                    for n, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity]
                        row.append(i)
                        piece.append(n)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(take) for c in ("did", "rk", "doc_id")), pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                        *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []),
                    ],
                    names=["did", "rk", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                )
                first = last
        # The process lives on beside later jobs: it keeps the word table, not the room for batches.
        pa.default_memory_pool().release_unused()

    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """did, rk, doc_id, piece, start, length, ids_crc32 (and ids) of every document."""
    base = C.documents_of(docs).select(*C.row_key(), "doc_id", "text")
    schema = "did long, rk int, doc_id long, piece int, start long, length long, ids_crc32 long"
    return base.mapInArrow(_piece_rows(tokenizer, capacity, with_ids), schema + (", ids array<int>" if with_ids else ""))


class Sums:
    """Sums of one, two and three lengths, by sum, under counts of what is ``left`` of each length.

    Built once over the lengths that are there; what is used up since is passed over. A
    triple stands as a length and the sum of a pair, so its entries are at most a square of
    the capacity, as those of pairs are.
    """

    def __init__(self, left: np.ndarray):
        self.left, capacity = left, len(left) - 1
        there = np.flatnonzero(left)
        i, j = np.tril_indices(len(there))
        first, total = there[i], there[i] + there[j]
        self._pairs, self._pair_at = self._sorted(first, total, capacity)
        two = np.flatnonzero(np.diff(self._pair_at))
        first = np.repeat(there, len(two))
        self._triples, self._triple_at = self._sorted(first, first + np.tile(two, len(there)), capacity)

    @staticmethod
    def _sorted(first: np.ndarray, total: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
        first, total = first[total <= capacity], total[total <= capacity]
        order = np.lexsort((-first, total))
        return first[order], np.searchsorted(total[order], np.arange(capacity + 2))

    def single(self, total: int) -> bool:
        return total > 0 and self.left[total] > 0

    def pairs(self, total: int) -> np.ndarray:
        """Larger lengths of the pairs that make ``total``, largest first."""
        a = self._pairs[self._pair_at[total] : self._pair_at[total + 1]]
        return a[(self.left[a] > 0) & (self.left[total - a] > 0)]

    def triples(self, total: int) -> np.ndarray:
        """Lengths that make ``total`` with some pair, largest first."""
        a = self._triples[self._triple_at[total] : self._triple_at[total + 1]]
        return a[self.left[a] > 0]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, sequences) that use up ``counts`` pieces of each length.

    Longest first, each with the single lengths, pairs and triples whose sums fill its gap
    exactly, as many times as there are pieces for; what is left by best fit.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, out = Sums(left), []

    def use(*lengths: int) -> None:
        pattern: dict[int, int] = {}
        for x in lengths:
            pattern[x] = pattern.get(x, 0) + 1
        n = int(min(left[x] // m for x, m in pattern.items()))
        if n:
            for x, m in pattern.items():
                left[x] -= n * m
            out.append((pattern, n))

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if left[length] and not gap:
            use(length)
        if left[length] and sums.single(gap):
            use(length, gap)
        for a in sums.pairs(gap).tolist() if left[length] else ():
            use(length, a, gap - a)
            if not left[length]:
                break
        for a in sums.triples(gap).tolist() if left[length] else ():
            for b in sums.pairs(gap - a).tolist() if left[a] else ():
                if b <= a:
                    use(length, a, b, gap - a - b)
                if not (left[a] and left[length]):
                    break
            if not left[length]:
                break
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest first, each into the open sequences with the smallest gap that takes it."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=0)
            if gap:
                pattern, there = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                # As many of this length into each as fit, if there are pieces enough for all of them.
                each = max(1, min(gap // length, n // there))
                used = min(there, n // each)
                if used < there:
                    open_.setdefault(gap, []).append((pattern, there - used))
            else:
                pattern, gap = {}, capacity
                each = max(1, min(gap // length, n))
                used = n // each
            fuller = pattern | {length: pattern.get(length, 0) + each}
            open_.setdefault(gap - each * length, []).append((fuller, used))
            n -= each * used
    return [x for kept in open_.values() for x in kept]


def _runs(patterns: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, sequences of the run, first sequence, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, dtype=np.int64)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            runs.setdefault(length, []).append((int(used[length]), n, sequence, offset))
            used[length] += n * pattern[length]
            offset += length * pattern[length]
        sequence += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def _place(runs):
    def rows(batches):
        table = runs.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, n, base, begin = table[int(x)]
                at = np.searchsorted(first, rank[own], "right") - 1
                inside = rank[own] - first[at]
                sequence[own] = base[at] + inside % n[at]
                offset[own] = begin[at] + inside // n[at] * x
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    Every row gives at least one piece: null and empty texts are the single id 0. Repeated
    rows are packed each. A text of any length is cut into pieces of ``capacity``; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with C.small_batches(docs.sparkSession):
        rows = C.stage(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = spark.sparkContext.broadcast(_runs(plan(counts, capacity), capacity))
    # One row for each length: at most ``capacity``.
    salts = spark.createDataFrame([(k, -(-n // SALT_ROWS)) for k, n in counts.items()], "length long, salts long")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("did", "rk", "piece"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("did", "rk", "piece")
    ranked = salted.withColumn("_n", F.row_number().over(within)).join(starts, ["length", "salt"])
    more = ["ids"] if with_ids else []
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *more, (F.col("before") + F.col("_n") - 1).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids array<int>, " if with_ids else "")
    return ranked.mapInArrow(_place(runs), schema + "sequence_id long, offset long")
