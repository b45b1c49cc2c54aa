"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its 4-word shingles; equal sets are one node throughout. A node's
signature has ``COORDINATES`` minima, each a (coordinate, value) pair and a posting list of
the nodes that have it. Two nodes whose sets are alike collide in ``matches`` coordinates or
more (up to a stated chance of missing), so of any ``COORDINATES - matches + 1`` coordinates
of one they share one. Lists are merged by that rule twice:

* Over the table, each node's pairs are ordered by how long their lists are. Pairs no other
  node has come first and need no list; only what is left of the prefix is posted. Values
  of a common passage are long lists at the end of this order: they are skipped, whoever
  has text of its own is not posted under them.
* Nodes that meet in posted lists form candidate groups, compared in blocks of bounded size.
  In a pair of blocks each probe merges its shortest lists only, again to the prefix, and
  counts the collisions in the skipped ones for the nodes found there.

Pairs above the match threshold are linked if their full sets say so. Pairs that links found
earlier already connect are passed over: no block returns more links than it has nodes. A
group of more than one block first meets a few of its own nodes, the pivots. Whoever they
connect fills blocks of its own, which are not compared with each other any more.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import common as C
from shelfspark.llm.components import components

WORDS = 4
#: Linked sets have a Jaccard similarity of so many hundredths.
PERCENT = 80
COORDINATES = 64
#: Chance that a pair at the similarity itself collides less often than asked for.
MISS = 1e-6
#: Nodes and bytes of text in one block, nodes that a large group meets first.
BLOCK, BLOCK_BYTES, PIVOTS = 1024, 32 << 20, 8
_random = np.random.default_rng(13)
_FLIP = _random.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
_ODD = _random.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)


def match_threshold(percent: int = PERCENT, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions that a pair of that similarity reaches but for a chance of ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of (coordinate, value) keys for each set; sets are runs of ``hashes`` and not empty."""
    out = np.empty((len(first), COORDINATES), dtype=np.uint64)
    for i in range(COORDINATES):
        out[:, i] = C.mix(np.minimum.reduceat((hashes ^ _FLIP[i]) * _ODD[i], first) + C.U64(i))
    return out


def _sketches(batches):
    """did, rk, doc_id, node (null for an empty set), n_shingles, sig."""
    for batch in batches:
        for a, hashes, at in C.shingle_sets(batch.column("text"), WORDS):
            size = np.diff(at)
            full = np.flatnonzero(size)
            node, sig = np.zeros(len(size), np.uint64), np.zeros((0, COORDINATES), np.uint64)
            if len(full):
                node[full], sig = C.Sequence(hashes).runs(at[full], at[full + 1]), signatures(hashes, at[full])
            bounds = np.concatenate(([0], np.cumsum((size > 0) * COORDINATES))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(a, len(size)) for c in ("did", "rk", "doc_id")), pa.array(C.signed(node), mask=size == 0), pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(C.signed(sig.ravel()))),
                ],
                names=["did", "rk", "doc_id", "node", "n_shingles", "sig"],
            )


def posts(nodes: DataFrame, matches: int, coordinates: int = COORDINATES) -> DataFrame:
    """(node, key): the lists that each node of ``nodes`` (node, sig) is posted under, shortest first.

    Of the first ``coordinates - matches + 1`` pairs of a node by list length those that
    another node has too. Two nodes with ``matches`` common pairs share one of them.
    """
    pairs = nodes.select("node", F.explode("sig").alias("key"))
    lists = C.stage(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    # Both sides of this join are plain shuffles, so Spark splits a list with a third of all nodes.
    held = pairs.join(lists, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"))
    left = F.size("held") - F.lit(matches - 1)
    return held.where(left > 0).select("node", F.explode(F.slice("held", F.lit(1), left)).alias("h")).select("node", "h.key")


def groups(posted: DataFrame) -> DataFrame:
    """(node, root): nodes that meet in posted lists, by a chain."""
    heads = C.stage(posted.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    return components(posted.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets, sorted and distinct, have that Jaccard similarity."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


class Lists:
    """Posting lists of a block: for each coordinate the places in order of their value."""

    def __init__(self, sig: np.ndarray):
        self.sig, self.order = sig, np.argsort(sig, axis=0, kind="stable")
        self.values = np.take_along_axis(sig, self.order, axis=0)

    def meet(self, probes: np.ndarray, matches: int) -> np.ndarray:
        """Which places (columns) each probe (row) meets in the shortest of its lists that suffice."""
        n, coordinates = self.sig.shape
        low = np.stack([np.searchsorted(self.values[:, c], probes[:, c], "left") for c in range(coordinates)], axis=1)
        high = np.stack([np.searchsorted(self.values[:, c], probes[:, c], "right") for c in range(coordinates)], axis=1)
        size = high - low
        prefix = np.argsort(size, axis=1, kind="stable")[:, : coordinates - matches + 1]
        probe = np.repeat(np.arange(len(probes)), prefix.shape[1])
        list_of, many = prefix.ravel(), np.take_along_axis(size, prefix, 1).ravel()
        row = C.ragged(np.take_along_axis(low, prefix, 1).ravel(), many)
        met = np.zeros((len(probes), n), dtype=bool)
        met[np.repeat(probe, many), self.order[row, np.repeat(list_of, many)]] = True
        return met


def links_between(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, part: np.ndarray, matches: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect all places of ``left`` with those of ``right`` that are alike, up to what ``part`` tells already."""
    part, out = part.copy(), []
    lists, same = Lists(sig[right]), left is right
    for i in range(0, len(left), 64):
        own = left[i : i + 64]
        if (part[right] == part[own[0]]).all() and (part[own] == part[own[0]]).all():
            continue
        met = lists.meet(sig[own], matches)
        for k, x in enumerate(own.tolist()):
            y = right[met[k]]
            y = y[(part[y] != part[x]) & ((y < x) | (not same))]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= matches]
            while len(y):
                one, y = int(y[0]), y[1:]
                if alike(sets[x], sets[one], percent):
                    out.append((x, one))
                    part[part == part[one]] = part[x]
                    y = y[part[y] != part[x]]
    return out


def _compare(matches: int, percent: int, words: int):
    """Links inside each tile; rows come sorted by tile, and a tile has two blocks at most."""

    def found(rows):
        node, side, known = (np.array([r[c] for r in rows]) for c in range(3))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        part = np.unique(known, return_inverse=True)[1]
        pairs = links_between(np.array([r[3] for r in rows]), [r[4] for r in rows], left, right if len(right) else left, part, matches, percent)
        return [(int(node[x]), int(node[y])) for x, y in pairs]

    def batch_of(pairs):
        both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def rows(batches):
        held, own = None, []
        for batch in batches:
            out = []
            tile, node, side, known = (batch.column(c).to_pylist() for c in ("tile", "node", "side", "known"))
            sig = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1)
            for a, hashes, at in C.shingle_sets(batch.column("text"), words):
                for k in range(len(at) - 1):
                    if tile[a + k] != held:
                        if own:
                            out += found(own)
                        held, own = tile[a + k], []
                    own.append((node[a + k], side[a + k], known[a + k], sig[a + k], hashes[at[k] : at[k + 1]].copy()))
            yield batch_of(out)
        if own:
            yield batch_of(found(own))

    return rows


_TILE = ["tile", "side", "node", "known", "sig", "text"]


def _run(tiles: DataFrame, matches: int, percent: int, words: int) -> DataFrame:
    """Links of ``tiles`` (see ``_TILE``): side 0 is compared with side 1, or with itself if there is none."""
    ordered = tiles.select(_TILE).repartition("tile").sortWithinPartitions("tile", "node")
    return ordered.mapInArrow(_compare(matches, percent, words), "a long, b long")


def _blocks(nodes: DataFrame, by: list[str], block: int) -> DataFrame:
    """The number of blocks that each group ``by`` of a table with node and size needs."""
    need = F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_BYTES)
    return nodes.groupBy(*by).agg(F.ceil(need).cast("int").alias("blocks"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("salt")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt")


def _pivot_links(members: DataFrame, sized: DataFrame, large: DataFrame, pivots: int, *rule: int) -> DataFrame:
    """Links of the nodes of large groups with the few nodes of their group that hash lowest."""
    order = Window.partitionBy("root").orderBy(F.xxhash64("node", F.lit(8)), "node")
    chosen = sized.join(large, "root").select("node", "blocks", F.row_number().over(order).alias("rank")).where(F.col("rank") <= pivots)
    met = chosen.select("node", _salts(), F.lit(0).alias("side")).union(sized.join(large, "root").select("node", _salt(), F.lit(1)))
    tiles = members.join(met, "node").withColumns({"known": F.col("node"), "tile": F.to_json(F.struct("root", "salt"))})
    return C.stage(_run(tiles, *rule), "met")


def links(members: DataFrame, matches: int, percent: int = PERCENT, words: int = WORDS, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) that connect all alike nodes of each group of ``members`` (root, node, sig, text)."""
    sized = members.select("root", "node", F.octet_length("text").alias("size"))
    large = C.stage(_blocks(sized, ["root"], block).where("blocks > 1"), "large")
    met, known = None, sized.withColumn("known", F.col("node"))
    if not large.isEmpty():
        met = _pivot_links(members, sized, large, pivots, matches, percent, words)
        connected = components(met).withColumnRenamed("root", "known")
        known = C.stage(sized.join(connected, "node", "left").withColumn("known", F.coalesce("known", "node")), "known")
    # What is connected and fills a quarter of a block has blocks of its own; the rest of a group is one lot.
    apart = C.stage(known.groupBy("known").count().where(F.col("count") * 4 >= block).select("known", F.col("known").alias("lot")), "apart")
    placed = known.join(apart, "known", "left").select("*", F.col("lot").isNotNull().alias("apart"))
    placed = C.stage(placed.withColumn("lot", F.coalesce("lot", F.lit(0))), "placed")
    lots = C.stage(_blocks(placed, ["root", "apart", "lot"], block), "lots")
    at = F.struct("apart", "lot", "salt").alias("at")
    blocks = lots.select("root", "apart", "lot", _salts()).select("root", at)
    pairs = blocks.join(blocks.withColumnRenamed("at", "to"), "root").where("at <= to and not (at.apart and to.apart and at.lot = to.lot)")
    ends = F.array(F.struct(F.col("at"), F.lit(0).alias("side")), F.struct(F.col("to").alias("at"), F.lit(1).alias("side")))
    ends = F.explode(F.when(F.col("at") == F.col("to"), F.slice(ends, 1, 1)).otherwise(ends)).alias("end")
    ends = pairs.select("root", F.to_json(F.struct("root", "at", "to")).alias("tile"), ends).select("root", "tile", "end.at", "end.side")
    dealt = placed.join(lots, ["root", "apart", "lot"]).select("root", "node", "known", "apart", "lot", _salt()).select("root", "node", "known", at)
    tiles = dealt.join(ends, ["root", "at"]).select("node", "known", "tile", "side").join(members, "node")
    found = _run(tiles, matches, percent, words)
    return found.union(met) if met is not None else found


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: groups of documents with alike shingle sets.

    Lower-cases A-Z; a text of fewer than ``WORDS`` words is one shingle. Sets are linked if
    100 * intersection >= ``percent`` * union; component_id is the smallest doc_id reachable,
    the row's own included, and kept tells whether it is the row's own. Null texts and texts
    without words have no shingles and no links. Repeated rows share a set and a component;
    rows without doc_id take part, and where a component has no doc_id at all component_id
    is null and kept false. An empty table gives no rows; other columns are ignored.
    """
    base = C.documents_of(docs).select(*C.row_key(), "doc_id", "text")
    rows = C.stage(base.mapInArrow(_sketches, "did long, rk int, doc_id long, node long, n_shingles long, sig array<long>"), "sketches")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct("did", "rk")).alias("first"), F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    nodes = C.stage(nodes, "nodes")
    matches = match_threshold(percent)
    # Different sets of fewer shingles cannot be that similar.
    posted = C.stage(posts(nodes.where(F.col("n") * (100 - percent) >= percent), matches), "posts")
    chosen = groups(posted).join(nodes, "node").select("root", "node", "sig", "first.did", "first.rk")
    texts = base.select("did", "rk", "text").join(chosen, ["did", "rk"])
    # Rows alike in id and text are one member.
    members = C.stage(texts.groupBy("root", "node").agg(F.first("sig").alias("sig"), F.first("text").alias("text")), "members")
    linked = components(links(members, matches, percent))
    named = nodes.select("node", "doc_id").join(linked, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    named = C.stage(named, "named")
    firsts = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # Both sides of the last join are plain shuffles, so Spark splits a set that a third of all rows have.
    named = C.stage(named.join(firsts, "root").select("node", "component_id"), "components")
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
