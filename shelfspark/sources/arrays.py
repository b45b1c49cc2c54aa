"""Elements of JSON array files of any size, read by many tasks.

Spark's text source splits a file anywhere and reads it as pieces between commas, so no
piece is longer than a number, a string or a bracket's edge. Which commas part elements
depends on what came before: open strings and brackets. A first pass tells of each split what it
does to that state, once if it should start outside a string and once if inside; from these
few numbers a split the driver works out with which state and at which element every split starts. The second pass
cuts the elements. Only an element that lies across splits is put together by a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a file may begin: an array, or an object that holds nothing but one.
SHAPES = {"array": r"^﻿?\s*\[", "results": r'^﻿?\s*\{\s*"results"\s*:\s*\[', "urls": r'^﻿?\s*\{\s*"urls"\s*:\s*\['}
_ENDS = {"array": r"\]\s*$", "results": r"\]\s*\}\s*$", "urls": r"\]\s*\}\s*$"}
_DEPTH = {"array": 1, "results": 2, "urls": 2}
#: Characters of a split's first and last pieces that the driver looks at.
_LOOK = 200


@dataclass(frozen=True)
class Start:
    """What holds where a split starts: the file's shape, brackets open, whether in a string, elements before."""

    shape: str
    depth: int
    string: bool
    element: int
    last: int


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _runs(batches) -> Iterator[tuple[str, int, list[str]]]:
    """(file, block, pieces) of runs of rows of one split, in order."""
    for batch in batches:
        files, blocks, values = (batch.column(c).to_pylist() for c in ("file", "block", "value"))
        first = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[first] or blocks[i] != blocks[first]:
                yield files[first], blocks[first], values[first:i]
                first = i


class _Scan:
    """The state at every byte of some pieces with their commas."""

    def __init__(self, pieces: list[str], string: bool):
        data = np.frombuffer((",".join(pieces) + ",").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        place = np.arange(len(data))
        # A quote counts unless an odd number of backslashes stands before it.
        solid = np.maximum.accumulate(np.where(data != 0x5C, place, -1))
        before = np.concatenate(([-1], solid[:-1]))
        quote = (data == 0x22) & ((place - 1 - before) % 2 == 0)
        inside = (np.cumsum(quote) + string) % 2 == 1
        free = ~inside & ~quote
        step = np.where(free & ((data == 0x5B) | (data == 0x7B)), 1, 0) - np.where(free & ((data == 0x5D) | (data == 0x7D)), 1, 0)
        self.data, self.depth = data, np.cumsum(step)
        self.commas = np.flatnonzero(free & (data == 0x2C))
        self.string = bool(inside[-1])


def _effects(batches):
    """For each split: how it begins and ends, and for both states it may start in what it does."""
    held: dict[tuple[str, int], dict] = {}
    for file, block, pieces in _runs(batches):
        own = held.setdefault((file, block), {"head": "", "tail": "", "string": [False, True], "depth": [0, 0], "commas": [{}, {}]})
        if len(own["head"]) < _LOOK:
            own["head"] = (own["head"] + ",".join(pieces[:64]) + ",")[:_LOOK]
        own["tail"] = (own["tail"] + ",".join(pieces[-64:])[-_LOOK:])[-_LOOK:]
        for v in (0, 1):
            scan = _Scan(pieces, own["string"][v])
            levels, times = np.unique(scan.depth[scan.commas] + own["depth"][v], return_counts=True)
            for level, n in zip(levels.tolist(), times.tolist(), strict=True):
                own["commas"][v][level] = own["commas"][v].get(level, 0) + n
            own["string"][v], own["depth"][v] = scan.string, own["depth"][v] + int(scan.depth[-1])
    rows = [(f, b, json.dumps(own)) for (f, b), own in held.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "block", "effect"])


def starts(spark: SparkSession, path: str) -> tuple[dict[tuple[str, int], Start], set[str], set[str]]:
    """(start of each split of files that are arrays, other files with an object or a broken array, files of other text).

    One row a split reaches the driver.
    """
    found = _pieces(spark, path).mapInArrow(_effects, "file string, block long, effect string").collect()
    files: dict[str, list[tuple[int, dict]]] = {}
    for r in found:
        files.setdefault(r.file, []).append((r.block, json.loads(r.effect)))
    out, objects, lines = {}, set(), set()
    for file, splits in files.items():
        splits.sort(key=lambda s: s[0])
        head, tail = splits[0][1]["head"], splits[-1][1]["tail"]
        shape = next((s for s, p in SHAPES.items() if re.match(p, head)), None)
        if shape is None:
            (objects if re.match(r"^﻿?\s*[{\[]", head) else lines).add(file)
            continue
        level, depth, string, element, own, outer = _DEPTH[shape], 0, False, 0, {}, 0
        for block, e in splits:
            own[block] = (depth, string, element)
            commas = e["commas"][string]
            element += commas.get(str(level - depth), 0)
            outer += sum(n for k, n in commas.items() if 0 < int(k) + depth < level)
            depth, string = depth + e["depth"][string], e["string"][string]
        if depth or string or outer or not re.search(_ENDS[shape], tail):
            objects.add(file)
            continue
        out |= {(file, b): Start(shape, d, s, n, element) for b, (d, s, n) in own.items()}
    return out, objects, lines


def _cut(known):
    """(file, ord, block, part, edge): elements as text, and the parts of those that lie across splits."""

    def rows(batches):
        state: dict[tuple[str, int], list] = {}

        def batch_of(made):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["file", "ord", "block", "part", "edge"])

        for file, block, pieces in _runs(batches):
            start = known.value.get((file, block))
            if start is None:
                continue
            depth, string, element, rest = state.setdefault((file, block), [start.depth, start.string, start.element, b""])
            scan = _Scan(pieces, string)
            cuts = scan.commas[scan.depth[scan.commas] + depth == _DEPTH[start.shape]]
            data, made, at = scan.data.tobytes(), [], 0
            for c in cuts.tolist():
                made.append((file, element, block, (rest + data[at:c]).decode("utf-8", "surrogatepass"), element == start.element and block > 0))
                element, rest, at = element + 1, b"", c + 1
            state[file, block] = [depth + int(scan.depth[-1]), scan.string, element, rest + data[at:]]
            if made:
                yield batch_of(made)
        # What follows the last comma goes on in the next split, or ends the file (whose text has no comma there).
        left = [(f, e, b, rest.decode("utf-8", "surrogatepass"), True) for (f, b), (_, _, e, rest) in state.items() if rest]
        if left:
            yield batch_of(left)

    return rows


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """((file, shape, ord, element) of the files that are arrays, files with other objects, files of other text).

    ``element`` is an element's JSON text as it stands; ``ord`` its place in the file. Arrays
    are plain, or the value of "results" or "urls" in an object without other keys. A file whose
    brackets or strings do not close counts as other.
    """
    known, objects, lines = starts(spark, path)
    shared = spark.sparkContext.broadcast(known)
    cut = _pieces(spark, path).mapInArrow(_cut(shared), "file string, ord long, block long, part string, edge boolean")
    across = cut.where("edge").groupBy("file", "ord").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p"))
    across = across.select("file", "ord", F.array_join(F.transform("p", lambda p: p["part"]), "").alias("element"))
    every = cut.where("not edge").select("file", "ord", F.col("part").alias("element")).union(across)
    shapes = {f: (s.shape, s.last) for (f, _), s in known.items()}

    def bare(batches):
        for batch in batches:
            files, ords, texts = (batch.column(c).to_pylist() for c in ("file", "ord", "element"))
            out = []
            for f, o, t in zip(files, ords, texts, strict=True):
                shape, last = shapes[f]
                if o == last:
                    # The scan puts a comma behind the end of the file.
                    t = re.sub(_ENDS[shape], "", t.removesuffix(","), count=1)
                out.append((re.sub(SHAPES[shape], "", t, count=1) if o == 0 else t).strip())
            kinds = [shapes[f][0] for f in files]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), pa.array(kinds, pa.string()), batch.column("ord"), pa.array(out, pa.string())], names=["file", "shape", "ord", "element"]
            )

    elements = every.mapInArrow(bare, "file string, shape string, ord long, element string").where("element <> ''")
    return elements, sorted(objects), sorted(lines)
