"""Ordered work over keys of any size: rank, running sums, previous row, smoothing.

A window partitioned by a key puts the whole key into one task. Here every key
is cut into chunks of its order value (an id range or a time slice), so the
largest unit of work is one chunk:

1. rows are windowed per (key, chunk);
2. one small row per (key, chunk) is aggregated with map-side combine;
3. offsets between chunks are prefix results over those small rows, again cut
   into groups of ``FAN`` chunks, and joined back on (key, chunk).

Chunks come from the data, never from partition ids, so a recomputed task after
an executor loss gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.core import epoch_micros

FAN = 1024
CHUNK, GROUP = "_chunk", "_group"


KEY = "_key"
ROWS_PER_CHUNK = 1_000_000


def _div(value: Column, width: Column | int) -> Column:
    return F.call_function("div", value, F.lit(width) if isinstance(width, int) else width)


def by_id(column: str, width: int = 65_536) -> Column:
    """Chunk of a unique integer order column: at most ``width`` rows per key."""
    return _div(F.col(column).cast("bigint"), width)


def by_time(column: str, seconds: float) -> Column:
    """Chunk of a timestamp order column."""
    return _div(epoch_micros(column), max(1, int(seconds * 1_000_000)))


def by_quantiles(df: DataFrame, column: str, rows: int = ROWS_PER_CHUNK) -> Column:
    """Chunk between quantiles of an order column (number or timestamp), taken from a sample.

    A chunk holds about ``rows`` rows of the whole table, hence no more of any key,
    wherever the values lie: an outlier, a burst or ids like hashes do not matter. The
    sample (by hash of the value, ``SAMPLE`` rows for each chunk) is sorted by Spark; its
    bounds, a number for each ``rows`` rows of the table, are broadcast and searched by
    bisection. The plan does not grow with the table.
    """
    kind = dict(df.dtypes)[column]
    value = epoch_micros(column) if kind.startswith("timestamp") else F.col(column)
    n = df.agg(F.count(column)).first()[0]
    if n <= rows:
        return F.lit(0).cast("bigint")
    rate, span = min(1.0, SAMPLE / rows), 1 << 30
    sample = df.select(value.alias("v")).where(F.col("v").isNotNull() & (F.pmod(F.xxhash64("v"), F.lit(span)) < int(rate * span)))
    step = max(1, round(rows * rate))
    runs = sample.orderBy("v").mapInArrow(_thinned(max(1, step // 4)), f"v {sample.schema['v'].dataType.simpleString()}, n long").collect()
    bounds, held = [], 0
    for r in sorted((r.v, r.n) for r in runs):
        held += r[1]
        if held >= step:
            bounds, held = [*bounds, r[0]], 0
    shared = df.sparkSession.sparkContext.broadcast(np.unique(np.array(bounds)))

    @F.arrow_udf("bigint")
    def chunk(values: pa.Array) -> pa.Array:
        known = values.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(values), np.int64)
        out[known] = np.searchsorted(shared.value, values.drop_null().to_numpy(zero_copy_only=False), "left")
        return pa.array(out)

    return chunk(value)


#: Sampled rows for each chunk.
SAMPLE = 64


def _thinned(step: int):
    """Of sorted values every ``step``-th and the last, with the number of values up to it."""

    def rows(batches):
        since, last = 0, None
        for batch in batches:
            if batch.num_rows:
                at = np.arange(step - 1 - since % step, batch.num_rows, step)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), step))], names=["v", "n"])
                since, last = (since + batch.num_rows) % step, batch.column(0).slice(batch.num_rows - 1)
        if since:
            yield pa.RecordBatch.from_arrays([last, pa.array([since])], names=["v", "n"])

    return rows


def keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Wrap the keys into one struct: null-safe, and still a plain equi-join key,
    so that the join back reuses the window's partitioning."""
    return (df.withColumn(KEY, F.struct(*keys)), [KEY]) if keys else (df, [])


def _ready(df: DataFrame, keys: Sequence[str], chunk: Column) -> tuple[DataFrame, list[str]]:
    return keyed(df.withColumn(CHUNK, chunk), keys)


def _join_back(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    return left.join(right, list(names), "left")


def prefix_sums(summary: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sum of each column over all earlier chunks of the key (two levels)."""
    s = summary.withColumn(GROUP, _div(F.col(CHUNK), FAN))
    inner = Window.partitionBy(*keys, GROUP).orderBy(CHUNK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    outer = Window.partitionBy(*keys).orderBy(GROUP).rowsBetween(Window.unboundedPreceding, -1)
    groups = s.groupBy(*keys, GROUP).agg(*[F.sum(c).alias(c) for c in sums])
    groups = groups.select(
        *keys, GROUP,
        *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_g_{c}") for c in sums],
    )
    s = s.select(
        *keys, CHUNK, GROUP,
        *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_c_{c}") for c in sums],
    )
    s = _join_back(s, groups, [*keys, GROUP])
    return s.select(*keys, CHUNK, *[(F.col(f"_c_{c}") + F.col(f"_g_{c}")).alias(c) for c in sums])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    totals: dict[str, tuple[Callable[[Column], Column], Column]] | None = None,
) -> DataFrame:
    """Add the 1-based rank, inclusive running sums and whole-key totals.

    ``order`` must be a total order, and ``chunk`` must not decrease along it.
    ``totals`` maps a name to (F.sum | F.min | F.max, expression).
    """
    sums, totals = sums or {}, totals or {}
    columns = df.columns
    df, keys = _ready(df, keys, chunk)
    named = {f"_s{i}": expr for i, expr in enumerate(sums.values())}
    summary = df.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_chunk_rows"),
        *[F.sum(e).alias(n) for n, e in named.items()],
        *[f(e).alias(n) for n, (f, e) in totals.items()],
    )
    before = prefix_sums(summary, keys, ["_chunk_rows", *named])
    if totals:
        # Totals of totals: sums, minima and maxima all compose.
        whole = summary.groupBy(*keys).agg(*[f(F.col(n)).alias(n) for n, (f, _) in totals.items()])
        before = _join_back(before, whole, keys)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    if rank:
        out = out.withColumn(rank, F.row_number().over(local).cast("bigint"))
    for name, expr in sums.items():
        out = out.withColumn(name, F.sum(expr).over(upto))
    out = _join_back(out, before, [*keys, CHUNK])
    if rank:
        out = out.withColumn(rank, F.col(rank) + F.col("_chunk_rows"))
    for tmp, name in zip(named, sums):
        out = out.withColumn(name, F.col(name) + F.col(tmp))
    added = ([rank] if rank else []) + list(sums) + list(totals)
    return out.select(*columns, *added)


def swept(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    back: Sequence[dict[str, str]] = (),
    smooth: tuple[str, float, str] | None = None,
) -> DataFrame:
    """Values of the rows before, and s = (1-alpha)*s + alpha*x, per key from 0, in one pass.

    ``back[0]`` maps new columns to those of the row before, ``back[1]`` (the same columns)
    to those of the row before that; null where a key has none. ``smooth`` is (x, alpha, s); a null x
    counts as 0.

    Rows are sorted once per (key, chunk) and walked in Arrow batches. What a chunk leaves to
    the next (its last rows, its own s and the weight of what came before it) is found by
    the same walk over the needed columns alone, and handed on from chunk to chunk in a walk over one
    row a chunk; no history is cut off.
    """
    columns, kinds = df.columns, dict(df.dtypes)
    df, keys = _ready(df, keys, chunk)
    place = [*keys, CHUNK]
    held = {v: f"_b{i}" for i, v in enumerate(back[0].values())} if back else {}
    value, alpha, name = smooth or (None, 0.0, None)
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if smooth else F.lit(0.0)
    flags = [F.col(f"{KEY}.{f.name}").isNull() for f in df.schema[KEY].dataType.fields] if keys else []
    mark = F.xxhash64(*place, *flags).alias("_mark")
    sortable = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    own = df.select(*place, mark, *sortable, *[F.col(v).alias(n) for v, n in held.items()], x.alias("_x"))
    by = [f"_o{i}" for i in range(len(order))]
    place_kind = [f"`{c}` {own.schema[c].dataType.simpleString()}" for c in place]
    last = [f"{n}{d} {kinds[v]}" for v, n in held.items() for d in ("l", "s")]
    ends = own.repartition(*place).sortWithinPartitions(*place, *by).mapInArrow(
        _ends(place, list(held.values()), alpha), ", ".join([*place_kind, *last, "_n long", "_s double"])
    )
    mark = F.xxhash64(*keys, *flags).alias("_mark") if keys else F.lit(0).cast("long").alias("_mark")
    ends = ends.select("*", mark)
    ends = (ends.repartition(*keys) if keys else ends.coalesce(1)).sortWithinPartitions(*place)
    carry = ends.mapInArrow(_carried(place, list(held.values()), alpha), ", ".join([*place_kind, *last, "_s double"]))
    mark = F.xxhash64(*place, *flags).alias("_mark")
    joined = df.repartition(*place).join(carry, place, "left").select("*", mark, x.alias("_x")).sortWithinPartitions(*place, *order)
    added = [(n, held[v], d, kinds[v]) for d, names in zip(("l", "s"), back) for n, v in names.items()]
    source = {n: v for v, n in held.items()}
    schema = [f"`{c}` {k}" for c, k in kinds.items()] + [f"`{n}` {k}" for n, _, _, k in added] + ([f"`{name}` double"] if smooth else [])
    return joined.mapInArrow(_walked(columns, source, added, alpha, name), ", ".join(schema))


def _starts(marks: np.ndarray, before: int | None) -> np.ndarray:
    out = np.ones(len(marks), dtype=bool)
    out[1:] = marks[1:] != marks[:-1]
    out[0] = before is None or marks[0] != before
    return out


def _shifted(column: pa.Array, start: np.ndarray, at_start: pa.Array, before: pa.Array | None) -> pa.Array:
    """The value one row back; ``at_start`` where a group starts, ``before`` from the batch before."""
    head = before if before is not None else pa.nulls(1, column.type)
    return pc.if_else(pa.array(start), at_start, pa.concat_arrays([head, column.slice(0, len(column) - 1)]))


def _smooth(x: list[float], start: list[bool], at_start: list[float], s: float, alpha: float) -> list[float]:
    keep, out = 1.0 - alpha, []
    for value, new, first in zip(x, start, at_start, strict=True):
        s = (first if new else s) * keep + value * alpha
        out.append(s)
    return out


def _ends(place: list[str], held: list[str], alpha: float):
    """One row for each chunk of sorted rows: its last two rows, their number, its own s."""

    def rows(batches):
        mark, n, s, last = None, 0, 0.0, None
        names = [*place, *(f"{h}{d}" for h in held for d in ("l", "s")), "_n", "_s"]

        def row(batch, i, second, count, value):
            cells = [batch.column(c).slice(i, 1) for c in place]
            for h in held:
                cells += [batch.column(h).slice(i, 1), second[h]]
            return pa.RecordBatch.from_arrays([*cells, pa.array([count]), pa.array([value])], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column("_mark").to_numpy()
            start = _starts(marks, mark)
            smoothed = _smooth(batch.column("_x").to_pylist(), start.tolist(), [0.0] * batch.num_rows, s, alpha)
            firsts = np.flatnonzero(start).tolist()
            if last is not None and start[0]:
                yield row(*last)
            for k, i in enumerate(firsts if firsts and firsts[0] == 0 else [0, *firsts]):
                stop = firsts[np.searchsorted(firsts, i, "right")] if np.searchsorted(firsts, i, "right") < len(firsts) else batch.num_rows
                n = stop - i if start[i] else n + stop - i
                earlier = {h: batch.column(h).slice(stop - 2, 1) if stop - 2 >= i else (last[0].column(h).slice(last[1], 1) if not start[i] else pa.nulls(1, batch.column(h).type)) for h in held}
                last = (batch, stop - 1, earlier, n, smoothed[stop - 1])
                if stop < batch.num_rows:
                    yield row(*last)
            mark, s = int(marks[-1]), smoothed[-1]
        if last is not None:
            yield row(*last)

    return rows


def _carried(place: list[str], held: list[str], alpha: float):
    """What comes before each chunk, from rows of chunks sorted by key: the last two rows, and s."""

    def rows(batches):
        mark, s, last = None, 0.0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column("_mark").to_numpy()
            start = _starts(marks, mark)
            sizes = batch.column("_n").to_numpy()
            before = []
            for new, n, e in zip(start.tolist(), sizes.tolist(), batch.column("_s").to_pylist(), strict=True):
                s = 0.0 if new else s
                before.append(s)
                s = s * (1.0 - alpha) ** n + e
            cells = []
            for h in held:
                # A chunk of one row leaves that row and the last one before it.
                ends, seconds = batch.column(f"{h}l"), batch.column(f"{h}s")
                none = pa.nulls(batch.num_rows, ends.type)
                lasts = _shifted(ends, start, none, last.get((h, "l")))
                seconds = pc.if_else(pa.array(sizes == 1), lasts, seconds)
                cells += [lasts, _shifted(seconds, start, none, last.get((h, "s")))]
                last[h, "l"], last[h, "s"] = ends.slice(batch.num_rows - 1), seconds.slice(batch.num_rows - 1)
            mark = int(marks[-1])
            names = [*place, *(f"{h}{d}" for h in held for d in ("l", "s")), "_s"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in place), *cells, pa.array(before)], names=names)

    return rows


def _walked(columns: list[str], source: dict[str, str], added: list[tuple], alpha: float, name: str | None):
    """Rows sorted by chunk, with the columns of the rows before and the smoothed value."""

    def rows(batches):
        mark, s, last = None, 0.0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = batch.column("_mark").to_numpy()
            start = _starts(marks, mark)
            made = {}
            for h, v in source.items():
                one = _shifted(batch.column(v), start, batch.column(f"{h}l"), last.get((h, "l")))
                made[h, "l"], made[h, "s"] = one, _shifted(one, start, batch.column(f"{h}s"), last.get((h, "s")))
                last[h, "l"], last[h, "s"] = batch.column(v).slice(batch.num_rows - 1), one.slice(batch.num_rows - 1)
            cells = [batch.column(c) for c in columns] + [made[h, d] for _, h, d, _ in added]
            if name is not None:
                smoothed = _smooth(batch.column("_x").to_pylist(), start.tolist(), batch.column("_s").to_pylist(), s, alpha)
                cells, s = [*cells, pa.array(smoothed)], smoothed[-1]
            mark = int(marks[-1])
            yield pa.RecordBatch.from_arrays(cells, names=[*columns, *(n for n, *_ in added), *([name] if name else [])])

    return rows


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: dict[str, str]) -> DataFrame:
    """Add the value of each column in the row before, null for a key's first row."""
    return swept(df, keys, order, chunk, [values])


def smoothed(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, alpha: float, name: str) -> DataFrame:
    """Add s = (1-alpha)*s + alpha*x per key, starting from 0; a null x counts as 0."""
    return swept(df, keys, order, chunk, smooth=(value, alpha, name))
