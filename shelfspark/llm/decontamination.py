"""Benchmark decontamination by spaced-seed hashing.

A mask of ones and zeros names the tokens of a window that count; the others may differ.
The masks below are chosen so that in 12 to 29 tokens any substitutions of up to a fifth of
them leave one mask whole somewhere; a longer stretch of that kind holds one of these. Items
under 12 tokens have masks of their own size: whole where no token may differ, else cut in
two blocks more than tokens may differ, any two of which a mask keeps. Each place of each text gives
one hash per mask in use. Test items give the same hashes; a Bloom filter of them (fixed
size) thins the training side before the exact join. A joined pair fixes how item and text line up; the texts of candidates are read
again and aligned token by token around the hit: the longest stretch that is equal in
``similarity`` of its places or more decides.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import common as C

MASKS = ("1111011", "11001000111", "11010110001", "111111")
#: Tokens of an item from which on these masks serve it.
LONG = 12
#: Bits of the Bloom filter, and hashes into it.
BLOOM_BITS = 1 << 23
BLOOM_HASHES = 2


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (runs of letters and digits, A-Z lower-cased) and the first token of each text."""
    folded = C.TERMS[raw]
    start, end, first = C.word_spans(folded, at)
    return C.span_hashes(folded, start, end), first


def spare(size: int, part: float) -> int:
    """Tokens of ``size`` that may differ."""
    return int(size * (1 - part) + 1e-9)


def masks_of(size: int, part: float) -> tuple[str, ...]:
    """The masks of an item of so many tokens of which ``part`` must agree."""
    if size >= LONG:
        return MASKS
    off = spare(size, part)
    if not off or size <= off + 1:
        return ("1" * size,) if size else ()
    cuts = [size * i // (off + 2) for i in range(off + 3)]
    kept = [[i for k in pair for i in range(cuts[k], cuts[k + 1])] for pair in combinations(range(off + 2), 2)]
    return tuple(dict.fromkeys("".join("1" if i in own else "0" for i in range(size)).strip("0") for own in kept))


def _seeds(tokens: np.ndarray, first: np.ndarray, masks: dict[str, tuple[np.ndarray | None, bool]]):
    """(hashes, places, texts) by mask, of windows that lie in one text.

    ``masks`` tells which texts have it (None: all) and whether a text's first place of each hash is enough.
    """
    for mask, (who, once) in masks.items():
        size = len(tokens) - len(mask) + 1
        if size <= 0:
            continue
        h = np.full(size, zlib.crc32(mask.encode()), dtype=np.uint64)
        for i in (i for i, c in enumerate(mask) if c == "1"):
            h = (h ^ tokens[i : i + size]) * C.U64(0x9FB21C651E98DF25)
            h ^= h >> C.U64(29)
        place = np.arange(size)
        text = np.searchsorted(first, place, "right") - 1
        inside = place + len(mask) <= first[text + 1]
        if who is not None:
            inside &= who[text]
        h, place, text = C.mix(h[inside]), place[inside], text[inside]
        if once and len(h):
            by = np.lexsort((place, h, text))
            keep = by[np.append(True, (h[by][1:] != h[by][:-1]) | (text[by][1:] != text[by][:-1]))]
            h, place, text = h[keep], place[keep], text[keep]
        yield h, place, text


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> C.U64(23 * i)) & C.U64(BLOOM_BITS - 1)).astype(np.int64) for i in range(BLOOM_HASHES)]


def _hits(sizes: list[int], part: float, model=None):
    """(h, keys, place) of every seed for items of such ``sizes`` (those under ``LONG``, and one for all others).

    Without a Bloom filter the texts are the items, each with the masks of its own size;
    with one every text has all masks, and only seeds the filter may hold are returned.
    """
    known = {size: masks_of(size, part) for size in sizes}
    # Whole items without spare tokens: where a text holds one first is all that counts.
    flexible = {m for size, masks in known.items() if spare(size, part) or size >= LONG for m in masks}

    def rows(batches):
        bloom = model.value if model is not None else None
        for batch in batches:
            keys = [c for c in batch.schema.names if c != "text"]
            for a, b, raw, at in C.text_chunks(batch.column("text")):
                tokens, first = _tokens(raw, at)
                length = np.minimum(np.diff(first), LONG)
                masks = {
                    m: (np.isin(length, [n for n in known if m in known[n]]) if bloom is None else None, m not in flexible)
                    for size in known for m in known[size]
                }
                for h, place, text in _seeds(tokens, first, masks):
                    if bloom is not None:
                        keep = np.ones(len(h), dtype=bool)
                        for slot in _slots(h):
                            keep &= bloom[slot]
                        h, place, text = h[keep], place[keep], text[keep]
                    if len(h):
                        take = pa.array(text + a)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(C.signed(h)), *(batch.column(k).take(take) for k in keys), pa.array(place - first[text])],
                            names=["h", *keys, "place"],
                        )

    return rows


def _sizes(batches):
    """The numbers of tokens that occur in a batch, ``LONG`` for all from there on."""
    for batch in batches:
        for _, _, raw, at in C.text_chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(np.diff(_tokens(raw, at)[1]), LONG)), pa.int32())], names=["size"])


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The filter of all hashes in ``seeds``, from at most BLOOM_BITS / 64 rows."""
    slots = F.explode(F.array(*(F.shiftrightunsigned("h", 23 * i).bitwiseAND(F.lit(BLOOM_BITS - 1)) for i in range(BLOOM_HASHES)))).alias("slot")
    words = (
        seeds.select(slots).groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).collect()
    )
    packed = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    for r in words:
        packed[r[0]] = r[1]
    return np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)


def _longest(same: np.ndarray, part: float) -> tuple[int, int]:
    """First and last + 1 place of the longest stretch equal in ``part`` of its places or more."""
    pre = np.concatenate(([0], np.cumsum(same.astype(np.float64) - part)))
    low = np.minimum.accumulate(pre)
    # For each end, the first start whose prefix is no higher.
    start = np.searchsorted(-low, -(pre + 1e-9), "left")
    length = np.arange(len(pre)) - start
    best = int(length.argmax())
    return int(start[best]), best


def _verify(part: float, least: int):
    def rows(batches):
        for batch in batches:
            lines = batch.column("lines").to_pylist()
            out: dict[str, list] = {k: [] for k in ("row", "item", "start", "at", "overlap", "same", "size")}
            for a, b, raw, at in C.text_chunks(batch.column("text")):
                tokens, first = _tokens(raw, at)
                for i in range(a, b):
                    own = tokens[first[i - a] : first[i - a + 1]]
                    items: dict[tuple, np.ndarray] = {}
                    for line in lines[i]:
                        key = (line["item_id"], line["item_text"])
                        if key not in items:
                            items[key] = _tokens(*C.text_bytes(pa.array([line["item_text"]])))[0]
                        item, shift = items[key], line["shift"]
                        lo, hi = max(0, -shift), min(len(item), len(own) - shift)
                        same = item[lo:hi] == own[lo + shift : hi + shift]
                        x, y = _longest(same, part)
                        if y - x >= min(least, len(item)) and y > x:
                            for k, v in zip(out, (i, line["item_id"], lo + x + shift, lo + x, y - x, int(same[x:y].sum()), len(item)), strict=True):
                                out[k].append(v)
            if out["row"]:
                take = pa.array(out.pop("row"), pa.int32())
                keys = [c for c in batch.schema.names if c not in ("text", "lines")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(take) for k in keys), *(pa.array(v, pa.int64()) for v in out.values())],
                    names=[*keys, "item_id", "start", "item_start", "overlap", "same", "item_size"],
                )

    return rows


def _keyed(docs: DataFrame) -> DataFrame:
    return C.documents_of(docs).where("text is not null").select(*C.row_key(), "doc_id", "text")


def overlaps(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least: int = 12) -> DataFrame:
    """did, rk, doc_id, item_id, start, item_start, overlap, same, item_size: the best alignment of each text and item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_text is not null").distinct()
    items = C.stage(items.withColumn("item", F.monotonically_increasing_id()), "items")
    texts = items.select("item", F.col("item_text").alias("text"))
    sizes = [r[0] for r in texts.select("text").mapInArrow(_sizes, "size int").distinct().collect()]  # at most LONG numbers
    seeds = C.stage(texts.mapInArrow(_hits(sizes, similarity), "h long, item long, place long"), "seeds")
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(seeds.select("h")))
    base = _keyed(docs)
    hits = base.select("did", "rk", "text").mapInArrow(_hits(sizes, similarity, bloom), "h long, did long, rk int, place long")
    lines = C.stage(
        hits.join(seeds.withColumnRenamed("place", "item_place"), "h")
        .select("did", "rk", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct(),
        "lines",
    )
    wanted = lines.join(items, "item").groupBy("did", "rk").agg(F.collect_list(F.struct("item_id", "item_text", "shift")).alias("lines"))
    found = base.join(wanted, ["did", "rk"]).mapInArrow(
        _verify(similarity, least),
        "did long, rk int, doc_id long, item_id long, start long, item_start long, overlap long, same long, item_size long",
    )
    order: Column = F.struct("overlap", "same", (-F.col("start")).alias("s"), "start", "item_start", "item_size")
    best = found.groupBy("did", "rk", "doc_id", "item_id").agg(F.max(order).alias("b"))
    return best.select("did", "rk", "doc_id", "item_id", "b.start", "b.item_start", "b.overlap", "b.same", "b.item_size")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least: int = 12) -> DataFrame:
    """doc_id, item_id, start, item_start, overlap, same, item_size, similarity: texts that hold benchmark passages.

    A row for each text and item where ``least`` tokens in line (or the whole item, if it is
    shorter) agree in ``similarity`` of their places; the longest such stretch is told.
    All of them are found at ``similarity`` 0.8 and ``least`` 12, for which the masks are
    made. Items without a token are never found; null and empty texts hold nothing; repeated rows of a table count once; rows without doc_id are told apart by
    text; other columns are ignored.
    """
    rows = overlaps(docs, benchmark, similarity, least)
    return rows.select(
        "doc_id", "item_id", "start", "item_start", "overlap", "same", "item_size", (F.col("same") / F.col("overlap")).alias("similarity")
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, least: int = 12) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, as ``contaminated`` tells them.

    Rows with null or empty text stay, repeated rows stay or go together, rows without
    doc_id are told apart by text; an empty benchmark leaves all rows.
    """
    bad = overlaps(docs, benchmark, similarity, least).select(F.col("did").alias("_did"), F.col("rk").alias("_rk")).distinct()
    keyed = docs.withColumns(dict(zip(("_did", "_rk"), C.row_key(), strict=True)))
    return keyed.join(bad, ["_did", "_rk"], "left_anti").select(docs.columns)
