"""Shared pieces: staged tables, row keys, words of whole text batches as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.session import scratch_path

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: The white space that parts words, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of terms (letters and digits of ASCII, and all others than ASCII) with A-Z lower-cased; the rest is white space.
TERMS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20):
    """Jobs started inside hand rows to Python in batches of about ``size`` bytes.

    The session's own limit counts rows (10,000), which says nothing of long texts; a smaller
    limit in bytes stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not before.isdigit() or int(before) > size:
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and ``more`` only: further columns cannot clash with derived ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def row_key() -> list[Column]:
    """(did, rk): tells rows apart also where doc_id is null or repeated.

    Rows alike in id and text share a key and are handled alike. Neither column is
    ever null, so plain equality joins hold.
    """
    return [
        F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("did"),
        F.hash("text").alias("rk"),
    ]


def fold_in(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; rows without an id count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(0))


def hash_sample(df: DataFrame, group: str, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of each ``group``, those of lowest hash of ``keys``.

    Group sizes come first, so that only about 4 n + 100 rows of a group reach the task
    that ranks them, however large the group is.
    """
    span = 1 << 31
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    hashed = df.withColumn("_h", F.pmod(F.xxhash64(*keys), F.lit(span)))
    near = hashed.join(sizes, group).where(F.col("_h") <= F.lit(span) * ((4.0 * n + 100) / F.col("_size")))
    order = Window.partitionBy(group).orderBy("_h", *keys)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n", "_h", "_size")


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = powers(1, 0)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the bounds of its values (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_chunks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of runs of about ``size`` bytes of whole texts."""
    raw, at = text_bytes(texts)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (one more: all)."""
    solid = np.empty(len(raw) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[raw], out=solid[1:-1])
    begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    if len(raw):
        inner = at[(at > 0) & (at < len(raw))]
        begins[inner] = solid[1:-1][inner]
        ends[inner - 1] = solid[1:-1][inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


_bytes = Powers(0xD6E8FEB86659FD93)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = _bytes.of(len(raw) + 1)
    pre = np.empty(len(raw) + 1, dtype=U64)
    pre[0] = 0
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=pre[1:])
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(U64))


_tokens = Powers(_BASE)


class Sequence:
    """Hashes of any run of tokens, from prefix sums over one array of token hashes."""

    def __init__(self, tokens: np.ndarray, powers_of: Powers = _tokens):
        up, self.down = powers_of.of(len(tokens) + 1)
        self.pre = np.empty(len(tokens) + 1, dtype=U64)
        self.pre[0] = 0
        np.cumsum(tokens * up[: len(tokens)], out=self.pre[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.pre[end] - self.pre[start]) * self.down[start] + (end - start).astype(U64))

    def windows(self, n: int) -> np.ndarray:
        m = max(0, len(self.pre) - n)
        return mix((self.pre[n:] - self.pre[:m]) * self.down[:m])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0].. start[0]+length[0]-1, start[1].. and so on."""
    total = int(length.sum())
    base = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return base + np.arange(total)


def shingle_sets(texts: pa.Array, words: int):
    """(first row, hashes, bounds) of runs of texts: each text's distinct shingle hashes, sorted.

    Lower-cases A-Z. A text of at most ``words`` words is one shingle, one without words none.
    """
    for a, b, raw, at in text_chunks(texts):
        raw = LOWER[raw]
        start, end, word_at = word_spans(raw, at)
        seq = Sequence(span_hashes(raw, start, end))
        n = np.diff(word_at)
        many = np.maximum(n - words + 1, 0) * (n > words)
        long = ragged(word_at[:-1], many)
        short = np.flatnonzero((n > 0) & (n <= words))
        text = np.concatenate([np.repeat(np.arange(b - a), many), short])
        hashes = np.concatenate([seq.windows(words)[long], seq.runs(word_at[short], word_at[short + 1])])
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        yield a, hashes[new], np.searchsorted(text[new], np.arange(b - a + 1))
