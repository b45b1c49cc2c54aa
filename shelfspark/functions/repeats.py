"""Repetition between the sentences of a document, in numbers, over whole Arrow batches.

Sentences come as arrays of match keys, one array a document. A batch's different keys
become numbers once: word ids, a 64-bit sketch of the words, lengths, letter counts. A rule
is then arithmetic over arrays of pairs: cheap bounds first, exact counts for what they
leave, and matching blocks of characters last, for the few pairs that only similarity can
decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs judged at once.
_SPAN = 1 << 16
#: Sentences of whole documents that are held as numbers at once.
_SENTENCES = 1 << 14
# Letters whose counts bound the similarity; any set is valid, common ones prune best.
_LETTERS = "etnaisorhdlu "


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .. and so on."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


class Blocks:
    """Matching blocks of two texts: the longest common run, then the same on both sides of it.

    Equal characters lie on diagonals; runs along them are kept as segments, and the longest
    block of a part is the longest segment clipped to it (of equal ones that which ends
    first). In a second text of 200 characters or more, characters that make up over a
    hundredth of it start no block but lengthen one they touch.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        values, kind, times = np.unique(b, return_inverse=True, return_counts=True)
        rare = times <= len(b) // 100 + 1 if len(b) >= 200 else np.ones(len(values), bool)
        self.plain = bool(rare.all())
        order = np.argsort(kind, kind="stable")
        start = np.cumsum(times) - times
        at = np.minimum(np.searchsorted(values, a), max(0, len(values) - 1))
        many = np.where((values[at] == a) & rare[at], times[at], 0) if len(values) else np.zeros(len(a), int)
        i = np.repeat(np.arange(len(a)), many)
        j = order[_ragged(start[at], many)] if len(values) else np.zeros(0, int)
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
        first = np.flatnonzero(new)
        self.i, self.j, self.n = i[first], j[first], np.diff(np.append(first, len(i)))

    def _longest(self, own: np.ndarray, alo: int, ahi: int, blo: int, bhi: int):
        """(i, j, length, segments that reach into the part)."""
        i, j, n = self.i[own], self.j[own], self.n[own]
        cut = np.maximum(0, np.maximum(alo - i, blo - j))
        size = np.minimum(n, np.minimum(ahi - i, bhi - j)) - cut
        live = size > 0
        if not live.any():
            return alo, blo, 0, own[:0]
        i, j, size = (i + cut)[live], (j + cut)[live], size[live]
        top = np.flatnonzero(size == size.max())
        best = top[np.lexsort((j[top], i[top]))[0]]
        return int(i[best]), int(j[best]), int(size[best]), own[live]

    def matched(self, enough: float = float("inf"), least: float = 0) -> int:
        """Characters in all blocks; a lower count once it reaches ``enough`` or cannot reach ``least``."""
        a, b, total = self.a, self.b, 0
        parts = [(0, len(a), 0, len(b), np.arange(len(self.i)))]
        open_ = min(len(a), len(b))
        while parts and total < enough and total + open_ >= least:
            alo, ahi, blo, bhi, own = parts.pop()
            open_ -= min(ahi - alo, bhi - blo)
            i, j, n, own = self._longest(own, alo, ahi, blo, bhi)
            if not self.plain:
                while i > alo and j > blo and a[i - 1] == b[j - 1]:
                    i, j, n = i - 1, j - 1, n + 1
                while i + n < ahi and j + n < bhi and a[i + n] == b[j + n]:
                    n += 1
            if n:
                total += n
                for part in ((alo, i, blo, j, own), (i + n, ahi, j + n, bhi, own)):
                    if part[0] < part[1] and part[2] < part[3]:
                        open_ += min(part[1] - part[0], part[3] - part[2])
                        parts.append(part)
        return total


def ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over those of both texts; 1 for two empty ones."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in (a, b)]
    both = len(codes[0]) + len(codes[1])
    return 2 * Blocks(*codes).matched() / both if both else 1.0


class Keys:
    """The different match keys of a batch as numbers; none is empty."""

    def __init__(self, keys: pa.Array):
        self.texts = keys.to_pylist()
        split = pc.split_pattern(keys, " ")
        words = split.flatten().dictionary_encode()
        ids, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        key = np.repeat(np.arange(len(keys)), np.diff(split.offsets.to_numpy()))
        full = pc.not_equal(known, "").to_numpy(zero_copy_only=False)[ids] if len(ids) else np.zeros(0, bool)
        self.word, key = ids[full], key[full]
        self.at = np.searchsorted(key, np.arange(len(keys) + 1))
        self.words = np.diff(self.at)
        self.base = len(known) + 1
        self.sets = np.unique(key * self.base + self.word)
        self.set_at = np.searchsorted(self.sets, np.arange(len(keys) + 1) * self.base)
        self.distinct = np.diff(self.set_at)
        bit = np.left_shift(np.uint64(1), ((self.sets % self.base).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        self.sketch = np.zeros(len(keys), np.uint64)
        some = self.distinct > 0
        self.sketch[some] = np.bitwise_or.reduceat(bit, self.set_at[:-1][some]) if some.any() else 0
        self.chars = pc.utf8_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
        self.letters = np.stack([pc.count_substring(keys, c).to_numpy(zero_copy_only=False) for c in _LETTERS], axis=1).astype(np.int32)

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of different words that both keys have."""
        small, large = np.where(self.distinct[a] <= self.distinct[b], a, b), np.where(self.distinct[a] <= self.distinct[b], b, a)
        n = self.distinct[small]
        words = self.sets[_ragged(self.set_at[small], n)] % self.base + np.repeat(large, n) * self.base
        at = np.minimum(np.searchsorted(self.sets, words), max(0, len(self.sets) - 1))
        pair = np.repeat(np.arange(len(small)), n)
        return np.bincount(pair, weights=self.sets[at] == words, minlength=len(small)).astype(np.int64) if len(words) else np.zeros(len(small), np.int64)

    def _lead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words at the start."""
        fewer = np.minimum(self.words[a], self.words[b])
        same = self.word[_ragged(self.at[a], fewer)] == self.word[_ragged(self.at[b], fewer)]
        ends = np.cumsum(fewer)
        broken = np.append(np.flatnonzero(~same), len(same))
        first = broken[np.searchsorted(broken, ends - fewer)]
        return np.minimum(first - (ends - fewer), fewer)

    def _alike(self, a: int, b: int, need: float) -> bool:
        """Do matching blocks make up ``need`` of both texts?"""
        codes = [np.frombuffer(self.texts[x].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in (a, b)]
        both = len(codes[0]) + len(codes[1])
        edge = need * both / 2
        return 2 * Blocks(*codes).matched(edge + 1, edge - 1) / both >= need

    def repeats(self, a: np.ndarray, b: np.ndarray, similar: bool) -> np.ndarray:
        """Does key a repeat the earlier key b?

        It does if they are equal, one of four words or more starts the other and makes up
        0.45 of it, they share four leading words and 0.55 of the shorter, or, from three
        words on, 0.88 of the smaller word set; with ``similar`` also if they are 0.9 alike,
        or 0.8 and share 0.68 of the words.
        """
        out = a == b
        fewer, more = np.minimum(self.words[a], self.words[b]), np.maximum(self.words[a], self.words[b])
        smaller = np.maximum(1, np.minimum(self.distinct[a], self.distinct[b]))
        by_size = self.distinct[a] <= self.distinct[b]
        lacks = np.where(by_size, self.sketch[a] & ~self.sketch[b], self.sketch[b] & ~self.sketch[a])
        # A word the sketch of the larger set lacks is in the smaller set only.
        most = smaller - np.bitwise_count(lacks)
        share = np.zeros(len(a))
        near = np.flatnonzero(~out & (fewer >= 3) & (most >= 0.68 * smaller))
        share[near] = self._shared(a[near], b[near]) / smaller[near]
        out |= share >= 0.88
        first = np.flatnonzero(~out & (fewer >= 4))
        first = first[self.word[self.at[a[first]]] == self.word[self.at[b[first]]]]
        lead = self._lead(a[first], b[first])
        out[first] |= (lead >= 4) & (lead / fewer[first] >= 0.55)
        for p in first[(lead >= 3) & (fewer[first] / more[first] >= 0.45) & ~out[first]].tolist():
            short, long_ = (a[p], b[p]) if self.words[a[p]] <= self.words[b[p]] else (b[p], a[p])
            out[p] = self.texts[long_].startswith(self.texts[short])
        if similar:
            need = np.where(share >= 0.68, 0.8, 0.9)
            spare = (1 - need) * (self.chars[a] + self.chars[b]) + 1e-6
            open_ = np.flatnonzero(~out & (fewer >= 3) & (np.abs(self.chars[a] - self.chars[b]) <= spare))
            open_ = open_[np.abs(self.letters[a[open_]] - self.letters[b[open_]]).sum(axis=1) <= spare[open_]]
            for p in open_.tolist():
                out[p] = self._alike(a[p], b[p], need[p])
        return out


def _numbered(lists: pa.Array) -> tuple[Keys, np.ndarray, np.ndarray]:
    """Keys, the key of each sentence of the batch, and the bounds of the documents."""
    encoded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return Keys(encoded.dictionary), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _judged(keys: Keys, key: np.ndarray, i: np.ndarray, j: np.ndarray, similar: bool) -> np.ndarray:
    parts = [keys.repeats(key[i[s : s + _SPAN]], key[j[s : s + _SPAN]], similar) for s in range(0, len(i), _SPAN)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _near(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All (sentence, one of the ``window`` before it in its document)."""
    place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
    before = np.minimum(place, window)
    i = np.repeat(np.arange(at[-1]), before)
    return i, _ragged(np.arange(at[-1]) - before, before)


def _by_parts(lists: pa.Array, judge) -> pa.Array:
    """``judge`` of a batch, some documents at a time: of as many as have about ``_SENTENCES`` sentences."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    out, a, done = [], 0, 0
    while a < len(lists) or not out:
        b = min(max(a + 1, int(np.searchsorted(ends, done + _SENTENCES, "right"))), len(lists))
        out.append(judge(lists.slice(a, b - a)))
        a, done = b, int(ends[b - 1]) if b else 0
    return pa.concat_arrays(out)


def pairs(keys: Column, window: int, similar: bool) -> Column:
    """array<struct<idx, prev_idx>> of the sentences that repeat one of the ``window`` before."""
    schema = T.ArrayType(T.StructType([T.StructField("idx", T.LongType()), T.StructField("prev_idx", T.LongType())]))

    def judge(lists: pa.Array) -> pa.Array:
        numbered, key, at = _numbered(lists)
        i, j = _near(at, window)
        hit = _judged(numbered, key, i, j, similar)
        i, j = i[hit], j[hit]
        base = np.repeat(at[:-1], np.diff(at))[i] if len(i) else i
        rows = pa.StructArray.from_arrays([pa.array(i - base), pa.array(j - base)], names=["idx", "prev_idx"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(i, at).astype(np.int32)), rows)

    @F.arrow_udf(schema)
    def found(lists: pa.Array) -> pa.Array:
        return _by_parts(lists, judge)

    # Not to be moved into other expressions, where it would run again, or into a lambda, where it cannot run.
    return found.asNondeterministic()(keys)


class Walk:
    """Which sentences of one document stay: those that repeat none of the last ``window`` kept.

    ``earlier`` tells, of a sentence, which ones before it it repeats; for sentence k that is
    known up to ``reach[k]`` places on. Equal keys need no telling.
    """

    def __init__(self, key: list[int], window: int):
        self.key, self.window = key, window
        self.earlier: dict[int, list[int]] = {}
        self.reach = [window] * len(key)

    def run(self) -> tuple[list[bool], dict[int, int]]:
        """(kept flags, the places on up to which it lacks what a kept sentence is repeated by)."""
        rank, last, kept, lacking = [-1] * len(self.key), {}, [], {}
        for i, own in enumerate(self.key):
            oldest = len(kept) - self.window
            if last.get(own, -1) >= max(oldest, 0):
                continue
            if any(rank[j] >= max(oldest, 0) for j in self.earlier.get(i, ())):
                continue
            if kept and i - kept[max(oldest, 0)] > self.window:
                for k in kept[max(oldest, 0) :]:
                    if i - k > self.reach[k]:
                        lacking[k] = i - k
            rank[i] = last[own] = len(kept)
            kept.append(i)
        return [r >= 0 for r in rank], lacking


def kept(keys: Column, window: int, similar: bool | None) -> Column:
    """array<boolean>: which sentences stay. ``similar`` None asks for equal keys only.

    Rounds: what is within the window of each other is judged first; a walk that needs to
    know more of a kept sentence, because others between were dropped, has it judged
    four times as far on, and walks again.
    """

    def judge(lists: pa.Array) -> pa.Array:
        numbered, key, at = _numbered(lists) if similar is not None else (None, *_ids(lists))
        walks = [Walk(key[a:b].tolist(), window) for a, b in zip(at[:-1], at[1:], strict=True)]
        if similar is None:
            for w in walks:
                w.reach = [len(w.key)] * len(w.key)
        else:
            doc = np.repeat(np.arange(len(walks)), np.diff(at))
            i, j = _near(at, window)
        out: list[list[bool]] = [[] for _ in walks]
        todo = list(range(len(walks)))
        while todo:
            if similar is not None:
                hit = _judged(numbered, key, i, j, similar)
                for x, y in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                    d = doc[x]
                    walks[d].earlier.setdefault(x - int(at[d]), []).append(y - int(at[d]))
            more_i, more_j, again = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for d in todo:
                out[d], lacking = walks[d].run()
                for k, far in lacking.items():
                    old, new = walks[d].reach[k], min(max(far, 4 * walks[d].reach[k]), len(out[d]) - 1 - k)
                    more_i.append(np.arange(k + old + 1, k + new + 1) + at[d])
                    more_j.append(np.full(new - old, k + at[d]))
                    walks[d].reach[k] = new
                if lacking:
                    again.append(d)
            todo, i, j = again, np.concatenate(more_i), np.concatenate(more_j)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array([f for x in out for f in x], pa.bool_()))

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def flags(lists: pa.Array) -> pa.Array:
        return _by_parts(lists, judge)

    return flags.asNondeterministic()(keys)


def _ids(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    encoded = lists.flatten().dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
