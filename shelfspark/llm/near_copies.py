"""Near copies by word shingles: one document of each group whose shingle sets are alike.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or
more; groups are the connected components. Each set has a SimHash of 512 bits. At 0.8 about
78 of them differ (15.3 %), in the smallest sets 96; unlike texts differ in 256. All SimHashes of sets
near enough in size are compared: first 128 bits, bit-sliced, 64 pairs a machine word, then
all bits of what is left. Sizes a fifth apart cannot be 0.8 alike, so SimHashes stand in shelves of size, and only a shelf
and the next one meet, block by block. A pair at 0.8 is missed with a chance of at most 1e-6.
Nodes that meet, by a chain, form a candidate group. Inside it the first 64 bits
are compared bit-sliced once more, and what is left is linked only if the sets themselves say so.
Equal sets are one node throughout; large groups are compared block by block in tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import common as C
from shelfspark.llm.components import components
from shelfspark.llm.simhash import _forest, _link_batch, planes

WORDS = 5
SIMILARITY = 0.8
#: Bits of 64: 10 are expected to differ at 0.8 and 12 in the smallest sets, with deviations of 3.
RADIUS = 26
#: 64-bit words of a SimHash, and those of them that are compared bit-sliced.
PRINT_WORDS, SLICED_WORDS = 8, 2
#: The chance that a bit differs at 0.8: in sets under so many shingles (worst: 4 of 5), and in all others (worst: 12).
TINY, DIFFER_TINY, DIFFER = 12, 0.1875, 0.1612
#: SimHashes in one comparison block, and those that advance together.
PRINTS, PROBES = 32_768, 64
#: Sizes of one shelf lie within this factor; one that may be alike to another is at most a shelf away.
SHELF = 1.2501
#: Texts and bytes of text in one comparison block.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Groups of so few texts are compared by their sets alone.
_SMALL = 64


def radius(bits: int, differ: float, missed: float = 5e-7) -> int:
    """The number of differing bits that is exceeded with a chance of at most ``missed``."""
    chance = (1 - differ) ** bits
    left, k = 1 - chance, 0
    while left > missed:
        chance *= (bits - k) / (k + 1) * differ / (1 - differ)
        left, k = left - chance, k + 1
    return k


def simhashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, PRINT_WORDS): a bit is 1 if set in over half of a set's hashes; ``at`` bounds sets that are not empty.

    Eight bits are counted at a time in the bytes of a word, over 255 hashes at most.
    """
    size = np.diff(at)
    parts = -(-size // 255)
    first = np.cumsum(parts) - parts
    start = np.repeat(at[:-1] - 255 * first, parts) + 255 * np.arange(int(parts.sum()))
    out = np.empty((len(size), PRINT_WORDS), np.uint64)
    for w in range(PRINT_WORDS):
        h = C.mix(hashes + C.U64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) if w else hashes
        ones = np.empty((len(size), 8, 8), np.int64)
        for b in range(8):
            lanes = np.add.reduceat((h >> C.U64(b)) & C.U64(0x0101010101010101), start)
            ones[:, :, b] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
        out[:, w] = np.packbits(ones * 2 > size[:, None, None], axis=2, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()
    return out


def sketch(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest of the set, SimHash) of sets that are not empty."""
    return C.Sequence(hashes).runs(at[:-1], at[1:]), simhashes(hashes, at)


def _sketch_rows(batches):
    for batch in batches:
        for a, hashes, at in C.shingle_sets(batch.column("text"), WORDS):
            size = np.diff(at)
            full = np.flatnonzero(size)
            node, fp = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            sig = np.zeros((0, PRINT_WORDS), np.uint64)
            if len(full):
                node[full], sig = sketch(hashes, np.append(at[full], len(hashes)))
                fp[full] = sig[:, 0]
            bounds = np.concatenate(([0], np.cumsum((size > 0) * PRINT_WORDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(a, len(size)) for c in ("did", "rk", "doc_id")), pa.array(C.signed(node)), pa.array(C.signed(fp)),
                    pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(C.signed(sig.ravel()))),
                ],
                names=["did", "rk", "doc_id", "node", "fp", "n", "sig"],
            )


def within(sliced: np.ndarray, probes: np.ndarray, count: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(probe number, place) of all pairs at ``radius`` or fewer differing bits, 64 places a machine word.

    ``probes`` has a word, or a row of words, for each 64 planes of ``sliced``. Planes are added two
    at a time into carry-save counters, as are the carries of each counter into the next.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    probes = probes.reshape(len(probes), -1)
    levels = len(sliced).bit_length()
    sums = [np.zeros((len(probes), sliced.shape[1]), dtype=np.uint64) for _ in range(levels)]
    waits: list[np.ndarray | None] = [None] * (levels + 1)
    for p in range(len(sliced)):
        flip = np.where((probes[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1), full, np.uint64(0))
        x, k = sliced[p][None, :] ^ flip[:, None], 0
        while waits[k] is not None:
            y, waits[k] = waits[k], None
            odd = sums[k] ^ x
            x &= sums[k]
            x |= odd & y
            odd ^= y
            sums[k], k = odd, k + 1
        waits[k] = x
    for k in range(levels):
        x, waits[k], j = waits[k], None, k
        while x is not None and j < levels:
            sums[j], x = sums[j] ^ x, sums[j] & x
            j += 1
    over, equal = np.zeros_like(sums[0]), np.full_like(sums[0], full)
    for k in reversed(range(levels)):
        if radius >> k & 1:
            equal &= sums[k]
        else:
            over |= equal & sums[k]
            equal &= ~sums[k]
    if radius >> levels:
        over[:] = 0
    hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :count]
    return np.nonzero(hit)


def _near_prints(n: np.ndarray, prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of places, one of ``left`` and one of ``right``, near in size and SimHash."""
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    sliced = np.concatenate([planes(prints[right, w]) for w in range(SLICED_WORDS)])
    sizes, part, out = n[right], np.arange(len(n)), []
    percent = round(100 * SIMILARITY)
    for i in range(0, len(left), PROBES):
        own = left[i : i + PROBES]
        differ = DIFFER_TINY if n[own[0]] < TINY * 5 // 4 else DIFFER
        lo = int(np.searchsorted(sizes, -(-n[own[0]] * percent // 100))) // 64 * 64
        hi = int(np.searchsorted(sizes, n[own[-1]] * 100 // percent, "right"))
        for a in range(lo, hi, 64 * 256):
            b = min(hi, a + 64 * 256)
            probe, place = within(sliced[:, a // 64 : -(-b // 64)], prints[own, :SLICED_WORDS], b - a, radius(64 * SLICED_WORDS, differ))
            x, y = own[probe], right[a + place]
            open_ = (part[x] != part[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
            x, y = x[open_], y[open_]
            near = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64) <= radius(64 * PRINT_WORDS, differ)
            for u, v in _forest(x[near], y[near]):
                if part[u] != part[v]:
                    out.append((u, v))
                    part[part == part[v]] = part[u]
    return out


def _meet(batches):
    """Links of near SimHashes inside each (shelf, up, i, j); rows come sorted by it and a tile has two blocks at most."""

    def links_in(key, held):
        node, n, prints, side = (np.concatenate(c) for c in zip(*held, strict=True))
        places = np.arange(len(node))
        alone = not key[1] and key[2] == key[3]
        left, right = (places, places) if alone else (places[side == 0], places[side == 1])
        if not len(left) or not len(right) or len(node) < 2:
            return []
        return [(int(node[x]), int(node[y])) for x, y in _near_prints(n, prints, left, right)]

    key, held = None, []
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("shelf", "up", "i", "j")]
        node, n, side = (batch.column(c).to_numpy() for c in ("node", "n", "side"))
        prints = batch.column("sig").flatten().to_numpy().view(np.uint64).reshape(-1, PRINT_WORDS)
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*([0] if batch.num_rows else []), *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(int(c[a]) for c in cols)
            if own != key:
                if held:
                    yield _link_batch(links_in(key, held))
                key, held = own, []
            held.append((node[a:b].copy(), n[a:b].copy(), prints[a:b].copy(), side[a:b].copy()))
    if held:
        yield _link_batch(links_in(key, held))


def near_prints(nodes: DataFrame, block: int = PRINTS) -> DataFrame:
    """Links (a, b) that connect all nodes (node, n, sig) near in size and SimHash.

    A shelf of more than ``block`` SimHashes is dealt into blocks by hash, and each pair of blocks of a shelf, or
    of it and the next one, is a tile of its own: every pair is still compared.
    """
    shelved = nodes.select("node", "n", "sig", F.floor(F.log("n") / F.log(F.lit(SHELF))).cast("int").alias("shelf"))
    # One row a shelf, a hundred at most.
    blocks = {r.shelf: -(-r.rows // block) for r in shelved.groupBy("shelf").agg(F.count(F.lit(1)).alias("rows")).collect()}
    counts = F.create_map(*(F.lit(x) for kv in (blocks or {0: 1}).items() for x in kv))
    of = lambda shelf: F.coalesce(F.try_element_at(counts, shelf), F.lit(0))
    at, shelf = F.col("at"), F.col("shelf")
    tile = lambda s, up, i, j, side: F.struct(
        s.alias("shelf"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), F.lit(side).cast("int").alias("side"))
    each = lambda s, f: F.transform(F.filter(F.sequence(F.lit(0), of(s)), lambda o: o < of(s)), f)
    dealt = shelved.withColumn("at", F.pmod(F.xxhash64("node", F.lit(7)), of(shelf)).cast("int"))
    tiles = dealt.select("node", "n", "sig", F.explode(F.concat(
        each(shelf, lambda o: tile(shelf, 0, F.least(at, o), F.greatest(at, o), at > o)),
        each(shelf + 1, lambda o: tile(shelf, 1, at, o, 0)),
        each(shelf - 1, lambda o: tile(shelf - 1, 1, o, at, 1)),
    )).alias("t")).select("t.shelf", "t.up", "t.i", "t.j", "t.side", "node", "n", "sig")
    place = ["shelf", "up", "i", "j"]
    return tiles.repartition(*place).sortWithinPartitions(*place).mapInArrow(_meet, "a long, b long")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, sorted and distinct, have that Jaccard similarity."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def _links_of(prints: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the places ``left`` and ``right``."""
    n = np.array([len(s) for s in sets])
    part = np.arange(len(sets))
    out, sliced = [], planes(prints[right]) if len(sets) > _SMALL else None
    for i in range(0, len(left), 256):
        own = left[i : i + 256]
        if sliced is None:
            probe, place = np.repeat(np.arange(len(own)), len(right)), np.tile(np.arange(len(right)), len(own))
        else:
            probe, place = within(sliced, prints[own], len(right), RADIUS)
        bounds = np.searchsorted(probe, np.arange(len(own) + 1))
        for k, x in enumerate(own.tolist()):
            y = right[place[bounds[k] : bounds[k + 1]]]
            y = y[np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9]
            y = y[part[y] != part[x]]
            while len(y):
                one, y = int(y[0]), y[1:]
                if alike(sets[x], sets[one], similarity):
                    out.append((x, one))
                    part[part == part[one]] = part[x]
                    y = y[part[y] != part[x]]
    return out


def _compare(words: int, similarity: float):
    """Links inside each (root, tile); rows come sorted by it and a tile has two blocks at most."""

    def links_in(rows):
        node, fp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).view(np.uint64)
        side, places = np.array([r[2] for r in rows]), np.arange(len(rows))
        left, right = (places, places) if rows[0][4] else (places[side == 0], places[side == 1])
        return [(int(node[x]), int(node[y])) for x, y in _links_of(fp, [r[3] for r in rows], left, right, similarity)]

    def batch_of(pairs):
        found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def rows(batches):
        held, own = None, []
        for batch in batches:
            out = []
            root, i, j, side, node, fp = (batch.column(c).to_numpy().tolist() for c in ("root", "i", "j", "side", "node", "fp"))
            for a, hashes, at in C.shingle_sets(batch.column("text"), words):
                for k in range(len(at) - 1):
                    key = root[a + k], i[a + k], j[a + k]
                    if key != held:
                        if own:
                            out += links_in(own)
                        held, own = key, []
                    own.append((node[a + k], fp[a + k], side[a + k], hashes[at[k] : at[k + 1]].copy(), key[1] == key[2]))
            yield batch_of(out)
        if own:
            yield batch_of(links_in(own))

    return rows


def _members(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(root, node, fp, text) of every node whose SimHash is near another's."""
    percent = round(100 * SIMILARITY)
    # Smaller sets are alike only if they are equal.
    met = components(near_prints(nodes.where(F.col("n") * (100 - percent) >= percent)))
    chosen = met.join(nodes, "node").select("root", "node", "fp", "first.did", "first.rk")
    texts = C.documents_of(docs).select(*C.row_key(), "text")
    # Rows alike in id and text are one member.
    return texts.join(chosen, ["did", "rk"]).groupBy("root", "node", "fp").agg(F.first("text").alias("text"))


def links(members: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all nodes of one root whose shingle sets are alike.

    A group of more than ``block`` texts is dealt into blocks by hash, and each pair of
    its blocks is a tile of its own.
    """
    size = F.greatest(F.count(F.lit(1)) / block, F.sum(F.octet_length("text")) / BLOCK_BYTES)
    sizes = members.groupBy("root").agg(F.ceil(size).cast("int").alias("n"))
    dealt = members.join(sizes, "root").withColumn("at", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int"))
    tiles = dealt.select(
        "root", "node", "fp", "text",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(
            F.least("at", o).alias("i"), F.greatest("at", o).alias("j"), (F.col("at") > o).cast("int").alias("side")))).alias("t"),
    ).select("root", "t.i", "t.j", "t.side", "node", "fp", "text")
    place = ["root", "i", "j"]
    return tiles.repartition(*place).sortWithinPartitions(*place).mapInArrow(_compare(words, similarity), "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near copies: of each group the row with the smallest doc_id.

    Of rows alike in doc_id and text one stays; rows without doc_id come last in a group.
    Texts that are null or without words are one group.
    """
    base = C.documents_of(docs).select(*C.row_key(), "doc_id", "text")
    with C.small_batches(docs.sparkSession):
        rows = C.stage(base.mapInArrow(_sketch_rows, "did long, rk int, doc_id long, node long, fp long, n long, sig array<long>"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "did", "rk")
    nodes = C.stage(rows.groupBy("node").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    groups = components(links(C.stage(_members(nodes, docs), "members")))
    named = nodes.join(groups, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.did").alias("_did"), F.col("first.rk").alias("_rk"))
    keyed = docs.withColumns(dict(zip(("_did", "_rk"), C.row_key(), strict=True)))
    return keyed.join(kept, ["_did", "_rk"]).dropDuplicates(["_did", "_rk"]).select(docs.columns)
