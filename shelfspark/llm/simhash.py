"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 bits over word shingles. Any two that differ in at most three of
five blocks' bits agree on two whole blocks, so each of the ten pairs of blocks is a
join key of about 26 bits; distinct fingerprints only. Fingerprints of one key stand in
blocks whose bit planes lie vertically: word ``w`` of plane ``p`` holds bit ``p`` of 64
fingerprints. A probe flips planes where its own bit is set and adds them into
carry-save counters (ones, twos, and a sticky four for "beyond the radius"), 64
distances per machine word; a block is abandoned once all of its lanes are beyond.
Blocks of a key are compared pair by pair in tasks of their own, and each task hands on a
spanning forest of the links it found, not the links themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import common as C
from shelfspark.llm.components import components

#: Shingle hashes are XXH64 with this seed.
SEED = 42
#: Bounds of the five blocks of a fingerprint's bits.
BOUNDS = (0, 13, 26, 39, 52, 64)
#: Fingerprints in one comparison block.
BLOCK = 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(tokens) - words + 1)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + (np.arange(8) * 256)[None, :]).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(batches):
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column("text").to_pylist()]
        fp = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rk"), batch.column("doc_id"), fp], names=["did", "rk", "doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(did, rk, doc_id, fp) of every row; lower-cases A-Z, 3-word shingles, repeats included."""
    base = C.documents_of(docs).select(*C.row_key(), "doc_id", "text")
    return base.mapInArrow(_fingerprint_rows, "did long, rk int, doc_id long, fp long")


def _mask(low: int, high: int) -> int:
    return ((1 << (high - low)) - 1) << low


PAIRS = tuple(combinations(range(len(BOUNDS) - 1), 2))
_BLOCK_MASKS = np.array([_mask(a, b) for a, b in zip(BOUNDS, BOUNDS[1:], strict=False)], dtype=np.uint64)
_PAIR_MASKS = np.array([_BLOCK_MASKS[a] | _BLOCK_MASKS[b] for a, b in PAIRS], dtype=np.uint64)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of ``prints``: (64, words), bit i of word w of plane p is bit p of print 64 w + i."""
    n = -(-len(prints) // 64) * 64
    padded = np.zeros(n, dtype=np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(sliced: np.ndarray, probes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe number, place) of all pairs at three or fewer differing bits.

    Probes advance together through the planes: ones, twos and fours are carry-save
    counters with a lane for each print of the block. A probe whose lanes are all past
    the radius is abandoned; checked every eight planes.
    """
    live = np.arange(len(probes))
    words = sliced.shape[1]
    ones = np.zeros((len(probes), words), dtype=np.uint64)
    twos, over = ones.copy(), ones.copy()
    tail = np.zeros(words, dtype=np.uint64)
    if count % 64:
        tail[-1] = ~np.uint64((1 << (count % 64)) - 1)
    over |= tail
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        flip = np.where((probes[live] >> np.uint64(p)) & np.uint64(1), full, np.uint64(0))
        differ = sliced[p][None, :] ^ flip[:, None]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if p % 8 == 7:
            keep = ~(over == full).all(axis=1)
            if not keep.all():
                live, ones, twos, over = live[keep], ones[keep], twos[keep], over[keep]
            if not len(live):
                break
    hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little").astype(bool) if len(live) else np.zeros((0, words * 64), bool)
    row, place = np.nonzero(hit)
    return live[row], place


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a, b)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _links_of(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Forest of the links between two blocks of one key, 256 probes at a time."""
    if not len(left) or not len(right):
        return []
    sliced, found = planes(right), []
    for i in range(0, len(left), 256):
        probe, place = near(sliced, left[i : i + 256], len(right))
        x, y = left[i : i + 256][probe], right[place]
        apart = x != y
        found += _forest(x[apart].view(np.int64), y[apart].view(np.int64))
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return _forest(pairs[:, 0], pairs[:, 1])


#: Keys with so few fingerprints share one comparison block: what links across keys is a link too.
_SMALL = 64


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _compare(batches):
    """Links inside each (key, tile); rows come sorted by it and a tile has two blocks at most."""
    small: list[np.ndarray] = []

    def flush():
        if not small:
            return []
        together = np.concatenate(small)
        small.clear()
        return _links_of(together, together)

    def links_in(key, prints: list[np.ndarray], sides: list[np.ndarray]):
        fp = np.concatenate(prints)
        if len(fp) < 2:
            return []
        if key[2] == key[3] and len(fp) <= _SMALL:
            small.append(fp)
            return flush() if sum(map(len, small)) >= 4 * _SMALL else []
        side = np.concatenate(sides)
        left = fp[side == 0]
        return _links_of(left, left if key[2] == key[3] else fp[side == 1])

    held, prints, sides = None, [], []
    for batch in batches:
        out: list[tuple[int, int]] = []
        cols = [batch.column(c).to_numpy() for c in ("pair", "bits", "i", "j", "side", "fp")]
        n = len(cols[0])
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        for c in cols[:4]:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(c[a]) for c in cols[:4])
            if key != held:
                if held is not None:
                    out += links_in(held, prints, sides)
                held, prints, sides = key, [], []
            prints.append(cols[5][a:b].view(np.uint64).copy())
            sides.append(cols[4][a:b].copy())
        if out:
            yield _link_batch(out)
    if held is not None:
        yield _link_batch(links_in(held, prints, sides))
    yield _link_batch(flush())


def _bits_column(fp: Column, pair: int) -> Column:
    mask = int(_PAIR_MASKS[pair])
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) at 3 or fewer differing bits.

    A key with more than ``block`` fingerprints is dealt into blocks by hash, and each
    pair of its blocks is a tile of its own: every pair is still compared.
    """
    keyed = prints.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), _bits_column(F.col("fp"), i).alias("bits")) for i in range(len(PAIRS))))).alias("k")
    ).select("k.pair", "k.bits", "fp")
    sizes = keyed.groupBy("pair", "bits").count().where("count > 1")
    blocks = F.ceil(F.col("count") / block).cast("int")
    dealt = keyed.join(sizes, ["pair", "bits"]).select(
        "pair", "bits", "fp", blocks.alias("n"), F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int").alias("at")
    )
    tiles = dealt.select(
        "pair", "bits", "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(
            F.least("at", o).alias("i"), F.greatest("at", o).alias("j"), (F.col("at") > o).cast("int").alias("side")))).alias("t"),
    ).select("pair", "bits", "t.i", "t.j", "t.side", "fp")
    place = ["pair", "bits", "i", "j"]
    return tiles.repartition(*place).sortWithinPartitions(*place).mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    Texts that are null or without words have fingerprint zero and are linked like any
    other; repeated rows share a fingerprint; rows without doc_id take part, and a
    component of such rows alone has component_id null. Other columns are ignored.
    """
    rows = C.stage(fingerprints(docs), "prints")
    return _with_components(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_components(rows: DataFrame) -> DataFrame:
    """``rows`` with component_id and first_row, the (doc_id, did, rk) kept for the group."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "did", "rk")
    nodes = C.stage(rows.groupBy("fp").agg(F.min(order).alias("first")), "nodes")
    groups = components(links(nodes.select("fp")))
    joined = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    joined = C.stage(joined.select("fp", "first", F.coalesce("root", "fp").alias("root")), "groups")
    firsts = joined.groupBy("root").agg(F.min("first").alias("first_row"))
    named = joined.select("fp", "root").join(firsts, "root").select("fp", "first_row")
    return rows.join(named, "fp").withColumn("component_id", F.col("first_row.doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the row with the smallest doc_id.

    Of rows alike in doc_id and text one stays; rows without doc_id come last in a group.
    """
    rows = C.stage(fingerprints(docs), "prints")
    kept = (
        _with_components(rows)
        .where(F.struct("did", "rk") == F.struct("first_row.did", "first_row.rk"))
        .select("did", "rk").distinct()
    )
    names = docs.columns
    keyed = docs.withColumns(dict(zip(("_did", "_rk"), C.row_key(), strict=True)))
    kept = kept.select(F.col("did").alias("_did"), F.col("rk").alias("_rk"))
    return keyed.join(kept, ["_did", "_rk"]).dropDuplicates(["_did", "_rk"]).select(names)
