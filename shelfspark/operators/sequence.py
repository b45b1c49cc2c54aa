"""Ordered work: interleaving, counter rates, smoothing, segment timing.

Everything ordered within a key goes through ``plans.chunked``: a source, a
cluster or a script may hold a third of all rows and still spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.core import any_of, coalesce_fields, epoch_micros, to_float
from shelfspark.plans import chunked
from shelfspark.profiles import FALLBACK_CLOSE, FALLBACK_LINE


# ---- fair order ---------------------------------------------------------------
def interleave(
    df: DataFrame, cluster: str, order: str, chunk_width: int = 65_536
) -> DataFrame:
    """Round robin over clusters: one of each in turn, clusters by first appearance.

    Adds round_no and cluster_first and sorts by them.
    """
    ranked = chunked.running(
        df, [cluster], [order], chunked.by_id(order, chunk_width),
        rank="round_no", totals={"cluster_first": (F.min, F.col(order))},
    )
    return ranked.orderBy("round_no", "cluster_first")


def crawl_priority(depth: Column) -> Column:
    return F.greatest(F.lit(1000) - depth * 10, F.lit(0))


# ---- counters and load ------------------------------------------------------------
def _slices(df: DataFrame, ts: str, seconds: float | None) -> Column:
    """Time chunk of a fixed or measured length."""
    return chunked.by_time(ts, seconds) if seconds else chunked.by_quantiles(df, ts)


def _rates(now: tuple[str, str, str], before: tuple[str, str, str]) -> tuple[Column, Column]:
    """(responses per second, error rate) between two ticks of (time, responses, errors); null without a tick before."""
    (t, r, e), (t0, r0, e0) = now, before
    seconds = (epoch_micros(t) - epoch_micros(t0)) / F.lit(1e6)
    dr = F.greatest(F.lit(0), F.col(r) - F.col(r0))
    de = F.greatest(F.lit(0), F.col(e) - F.col(e0))
    has = F.col(t0).isNotNull()
    return F.when(has, dr / F.greatest(F.lit(0.2), seconds)), F.when(has, de / F.greatest(F.lit(1), dr + de))


def counter_rates(
    ticks: DataFrame,
    source: str,
    order: Sequence[str],
    responses: str = "responses",
    errors: str = "errors",
    slice_seconds: float | None = None,
) -> DataFrame:
    """Responses per second and error rate between consecutive ticks of a source.

    ``order`` starts with the timestamp. A source's first tick has no rates.
    """
    now = (order[0], responses, errors)
    before = ("_t", "_r", "_e")
    df = chunked.swept(ticks, [source], order, _slices(ticks, order[0], slice_seconds), [dict(zip(before, now, strict=True))])
    rps, error_rate = _rates(now, before)
    return df.withColumn("rps", rps).withColumn("error_rate", error_rate).drop(*before)


#: Weights of cpu, ram and gpu load.
PRESSURE = (0.50, 0.35, 0.15)


def pressure(cpu: Column, ram: Column, gpu: Column) -> Column:
    """Weighted load of percentages, 0..1."""
    a, b, c = PRESSURE
    return cpu / 100 * F.lit(a) + ram / 100 * F.lit(b) + gpu / 100 * F.lit(c)


def ewma(
    df: DataFrame,
    source: str,
    order: Sequence[str],
    value: str,
    alpha: float = 0.35,
    out: str = "smoothed",
    slice_seconds: float | None = None,
) -> DataFrame:
    """Exponentially smoothed value per source, starting from 0."""
    return chunked.smoothed(df, [source], order, _slices(df, order[0], slice_seconds), value, alpha, out)


def load_class(
    metrics: DataFrame, source: str, order: Sequence[str], slice_seconds: float | None = None
) -> DataFrame:
    """Brake factor from load and errors, and the falling-throughput flag.

    Needs cpu, ram, rps, error_rate and smoothed; a column ``previous_rps`` is
    used when there is one.
    """
    cpu, ram, err = (F.col(c) for c in ("cpu", "ram", "error_rate"))
    brake = (
        F.when((cpu >= 97) | (ram >= 96), 0.55)
        .when((cpu >= 93) | (ram >= 92), 0.75)
        .when(err >= 0.08, 0.60)
        .when(err >= 0.04, 0.80)
        .otherwise(1.0)
    )
    df = metrics
    if "previous_rps" not in df.columns:
        df = chunked.previous(
            df, [source], order, _slices(df, order[0], slice_seconds), {"previous_rps": "rps"}
        )
    before = F.col("previous_rps")
    falling = (before > 0) & (F.col("rps") < before * 0.75) & (F.col("smoothed") > 0.60)
    return (
        df.withColumn("brake", brake)
        .withColumn("throughput_drop", F.coalesce(falling, F.lit(False)))
        .drop("previous_rps")
    )


def load_metrics(
    ticks: DataFrame, source: str, order: Sequence[str], slice_seconds: float | None = None
) -> DataFrame:
    """Rates, smoothed pressure and load class of counter ticks in one go.

    One pass over the chunks gives the two ticks before each and the smoothed pressure; the
    rate of the tick before follows from its own two.
    """
    x = pressure(F.col("cpu"), F.col("ram"), F.col("gpu"))
    now, one, two = (order[0], "responses", "errors"), ("_t", "_r", "_e"), ("_t2", "_r2", "_e2")
    df = chunked.swept(
        ticks.withColumn("pressure", x), [source], order, _slices(ticks, order[0], slice_seconds),
        [dict(zip(one, now, strict=True)), dict(zip(two, now, strict=True))], ("pressure", 0.35, "smoothed"),
    )
    rps, error_rate = _rates(now, one)
    df = df.withColumns({"rps": rps, "error_rate": error_rate, "previous_rps": _rates(one, two)[0]}).drop(*one, *two)
    return load_class(df, source, order)


# ---- segment timing ---------------------------------------------------------------
#: Characters of text in one piece of a scene.
PIECE = 100_000


def _in_pieces(
    lines: DataFrame, keys: Sequence[str], order: str, texts: Sequence[str], size: int, chunk_width: int
) -> DataFrame:
    """Adds ``piece`` (from 1): neighbours whose ``texts`` fill ``size`` characters, by a running length.

    A piece exceeds ``size`` by less than one row.
    """
    length = sum((F.length(F.coalesce(F.col(t), F.lit(""))) + 1 for t in texts), F.lit(0)).cast("bigint")
    ran = chunked.running(
        lines.withColumn("_len", length), keys, [order], chunked.by_id(order, chunk_width), sums={"_run": F.col("_len")}
    )
    piece = F.floor((F.col("_run") - F.col("_len")) / F.lit(size)) + 1
    return ran.withColumn("piece", piece.cast("bigint")).drop("_len", "_run")


def _joined(text: Column, order: str, sep: str = " ") -> Column:
    """Texts of a group in order; null ones are left out."""
    entries = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t")))))
    return F.array_join(F.transform(entries, lambda e: e["t"]), sep)


def join_pieces(segments: DataFrame, key: str) -> DataFrame:
    """Scenes with their whole text in one value, where that is wanted and fits."""
    rest = [c for c in segments.columns if c not in (key, "scene_index", "piece", "line", "focus")]
    solid = lambda c: F.nullif(F.col(c), F.lit(""))
    texts = [F.trim(_joined(F.col("line"), "piece")).alias("line")]
    if "focus" in segments.columns:
        texts = [_joined(solid("focus"), "piece", " | ").alias("focus"), F.trim(_joined(solid("line"), "piece")).alias("line")]
    return segments.groupBy(key, "scene_index").agg(*[F.max(c).alias(c) for c in rest], *texts)


def assign_scenes(
    lines: DataFrame, key: str, order: str, scenes: int, chunk_width: int = 8_192
) -> DataFrame:
    """Scene of every line: at most max(2, scenes) groups of neighbours per script.

    Adds line_no, scene_index and scenes. Lines stay apart, so a script of any
    length spreads over tasks.
    """
    want = max(2, scenes)
    ranked = chunked.running(
        lines, [key], [order], chunked.by_id(order, chunk_width),
        rank="line_no", totals={"_lines": (F.sum, F.lit(1))},
    )
    size = F.when(F.col("_lines") > want, F.ceil(F.col("_lines") / want)).otherwise(1)
    return (
        ranked.withColumn("_size", size)
        .withColumn(
            "scene_index", (F.floor((F.col("line_no") - 1) / F.col("_size")) + 1).cast("bigint")
        )
        .withColumn("scenes", F.ceil(F.col("_lines") / F.col("_size")).cast("bigint"))
        .drop("_lines", "_size")
    )


def split_even(
    lines: DataFrame,
    key: str,
    order: str,
    text: str,
    total: Column,
    scenes: int,
    chunk_width: int = 8_192,
    piece_size: int = PIECE,
) -> DataFrame:
    """Even scenes of a script, of equal length, with their text in pieces; a
    lone line over six seconds gets a stock closing line. Blank lines do not count; a
    script without other lines gets stock lines.

    ``total`` is the script length in seconds. A scene's text comes as rows (scene_index,
    piece, line) of about ``piece_size`` characters each; ``join_pieces`` puts it together.
    """
    timed = lines.withColumn("_total", total.cast("double"))
    df = assign_scenes(
        timed.filter(F.trim(text) != ""), key, order, scenes, chunk_width
    )
    df = _in_pieces(df, [key, "scene_index"], "line_no", [text], piece_size, chunk_width)
    lone = (F.col("_n") < 2) & (F.col("_total") >= 6)
    pieces = df.groupBy(key, "scene_index", "piece").agg(
        _joined(F.col(text), "line_no").alias("line"), F.max("_total").alias("_total"), F.max("scenes").alias("_n")
    )
    head = {"scene_index": F.lit(2).cast("bigint"), "piece": F.lit(1).cast("bigint"), "line": F.lit(FALLBACK_CLOSE)}
    close = pieces.filter(lone & (F.col("scene_index") == 1) & (F.col("piece") == 1)).withColumns(head)
    segments = pieces.unionByName(close).withColumn("_n", F.when(lone, 2).otherwise(F.col("_n")))
    return _even(segments, key).unionByName(stock_scenes(timed, key, text))


def _bounds(df: DataFrame, key: str, start: Column, end: Column, *extra: str) -> DataFrame:
    return df.select(
        key,
        "scene_index",
        F.round(start, 3).alias("start_sec"),
        F.round(end, 3).alias("end_sec"),
        F.round(end - start, 3).alias("duration_sec"),
        *extra,
        "line",
    )


def allocate_weighted(
    rows: DataFrame,
    key: str,
    order: str,
    texts: Sequence[str],
    total: Column,
    min_seconds: float,
    start: Column | None = None,
    end: Column | None = None,
    chunk_width: int = 8_192,
    slice_seconds: float = 600.0,
) -> DataFrame:
    """Timed segments: a minimum each, the rest shared by weight.

    A weight is the given duration or the speech guess of the line, whichever is
    longer. The end of segment i is min*i + budget * (running weight / total
    weight), so one running sum replaces a walk over the script.
    """
    none = F.lit(None).cast("double")
    every = rows.withColumn("line", coalesce_fields(*texts))
    df = every.filter(F.col("line") != "")
    df = df.withColumn("_start", none if start is None else to_float(start)).withColumn(
        "_end", none if end is None else to_float(end)
    ).withColumn("_total", total.cast("double"))
    given = F.when(F.col("_end") > F.col("_start"), F.col("_end") - F.col("_start")).otherwise(0.0)
    words = F.regexp_count("line", F.lit(r"(?U)\S+"))
    df = df.withColumn(
        "_w",
        F.greatest(F.coalesce(given, F.lit(0.0)), F.lit(0.8), words * F.lit(0.35)),
    )
    # Rows with a start come first, by start; the others keep the input order, and their
    # chunks lie beyond any time slice.
    slice_no = F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), F.col("_start") / slice_seconds)))
    chunk = F.when(
        F.col("_start").isNull(), F.lit(2 * 10**12) + chunked.by_id(order, chunk_width)
    ).otherwise(slice_no.cast("bigint"))
    df = chunked.running(
        df, [key], [F.col("_start").asc_nulls_last(), F.col(order)], chunk, rank="scene_index", sums={"_run": F.col("_w")},
        totals={"_n": (F.sum, F.lit(1)), "_sum": (F.sum, F.col("_w"))},
    )
    floor = F.lit(max(0.4, float(min_seconds)))
    low = F.when(
        F.col("_n") * floor > F.col("_total"), F.greatest(F.lit(0.1), F.col("_total") / F.col("_n"))
    ).otherwise(floor)
    budget = F.greatest(F.lit(0.0), F.col("_total") - F.col("_n") * low)

    def at(i: Column, weight: Column) -> Column:
        return F.least(F.col("_total"), low * i + budget * (weight / F.col("_sum")))

    begin = at(F.col("scene_index") - 1, F.col("_run") - F.col("_w"))
    finish = F.when(F.col("scene_index") == F.col("_n"), F.col("_total")).otherwise(
        at(F.col("scene_index"), F.col("_run"))
    )
    begin = F.when(F.col("scene_index") == 1, F.lit(0.0)).otherwise(begin)
    last = F.col("scene_index") == F.col("_n")
    out = _bounds(df.withColumn("_b", begin).withColumn("_e", finish), key, F.col("_b"), F.col("_e"),
                  "_n", "_total")
    # The last segment ends at the total; its length follows from the rounded start.
    out = out.withColumn(
        "duration_sec",
        F.when(last, F.round(F.col("_total") - F.col("start_sec"), 3)).otherwise(F.col("duration_sec")),
    ).drop("_n", "_total")
    return out.unionByName(stock_scenes(every.withColumn("_total", total.cast("double")), key, "line").drop("piece"))


def stock_scenes(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Scenes of the scripts in ``rows`` (with _total) that have no usable line: a stock
    line, and a stock closing line from six seconds on."""
    blank = rows.groupBy(key).agg(
        F.max("_total").alias("_total"), F.max(F.coalesce(F.trim(line), F.lit("")) != "").alias("_any")
    ).filter(~F.col("_any"))
    scene = lambda i, text: F.struct(F.lit(i).cast("bigint").alias("scene_index"), F.lit(text).alias("line"))
    first, second = scene(1, FALLBACK_LINE), scene(2, FALLBACK_CLOSE)
    two = F.col("_total") >= 6
    found = blank.select(
        key, "_total", F.when(two, 2).otherwise(1).alias("_n"), F.lit(1).cast("bigint").alias("piece"),
        F.inline(F.when(two, F.array(first, second)).otherwise(F.array(first))),
    )
    return _even(found, key)


def _even(segments: DataFrame, key: str) -> DataFrame:
    """``_n`` scenes of equal length over ``_total``."""
    step = F.col("_total") / F.col("_n")
    last = F.col("scene_index") == F.col("_n")
    end = F.when(last, F.col("_total")).otherwise(step * F.col("scene_index"))
    return _bounds(segments, key, step * (F.col("scene_index") - 1), end, "piece")


def compress_groups(
    segments: DataFrame,
    key: str,
    max_segments: int,
    total: Column,
    focus: str | None = None,
    chunk_width: int = 8_192,
    piece_size: int = PIECE,
) -> DataFrame:
    """At most ``max_segments`` segments per script: neighbours are merged, their
    lengths summed, their texts put in line; shorter scripts pass unchanged.

    Segments carry scene_index 1..n, so groups follow from the index and a count. A merged
    segment's texts come as rows (scene_index, piece, focus, line) of about ``piece_size``
    characters each; ``join_pieces`` puts them together.
    """
    want = max(1, max_segments)
    df = segments.withColumn("_total", total.cast("double"))
    df = df.withColumn("_f", F.trim(F.lit("") if focus is None else F.col(focus))).withColumn("_t", F.trim("line"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    df = df.join(counts, key)
    size = F.when(F.col("_n") > want, F.ceil(F.col("_n") / want)).otherwise(1)
    df = df.withColumn("_size", size).withColumn(
        "_seg", (F.floor((F.col("scene_index") - 1) / F.col("_size")) + 1).cast("bigint")
    )
    merged = df.groupBy(key, "_seg").agg(
        F.sum("duration_sec").alias("_sum"),
        F.min_by("start_sec", "scene_index").alias("_first"),
        F.max_by("end_sec", "scene_index").alias("_last"),
        F.max("_total").alias("_total"),
        F.max("_n").alias("_n"),
        F.max(F.ceil(F.col("_n") / F.col("_size"))).alias("_groups"),
        F.max(F.col("_t") != "").alias("_spoken"),
        F.min("start_sec").alias("_start"), F.max("end_sec").alias("_end"),
    )
    guess = F.greatest(F.lit(0.1), F.col("_last") - F.col("_first"))
    merged = merged.withColumn("_dur", F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(guess))
    # A key has at most ``max_segments`` rows here, or passes unchanged.
    w = Window.partitionBy(key).orderBy("_seg")
    run = F.sum("_dur").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = merged.withColumn("_run", run)
    small = F.col("_n") <= want
    start = F.least(F.col("_total"), F.col("_run") - F.col("_dur"))
    end = F.least(F.col("_total"), F.col("_run"))
    last = F.col("_seg") == F.col("_groups")
    r_start = F.round(start, 3)
    timed = merged.select(
        key,
        "_seg",
        F.when(small, F.col("_start")).otherwise(r_start).alias("start_sec"),
        F.when(small, F.col("_end"))
        .when(last, F.round("_total", 3))
        .otherwise(F.round(end, 3))
        .alias("end_sec"),
        F.when(small, F.col("_sum"))
        .when(last, F.round(F.col("_total") - r_start, 3))
        .otherwise(F.round(end - start, 3))
        .alias("duration_sec"),
        (~F.coalesce("_spoken", F.lit(False)) & ~small).alias("_silent"),
    )
    pieces = _in_pieces(df.select(key, "_seg", "scene_index", "_t", "_f"), [key, "_seg"], "scene_index", ["_t", "_f"], piece_size, chunk_width)
    solid = lambda c: F.nullif(F.col(c), F.lit(""))
    pieces = pieces.groupBy(key, "_seg", "piece").agg(
        _joined(solid("_f"), "scene_index", " | ").alias("focus"), _joined(solid("_t"), "scene_index").alias("line")
    )
    stock = F.col("_silent") & (F.col("piece") == 1)
    return pieces.join(timed, [key, "_seg"]).select(
        key, F.col("_seg").alias("scene_index"), "piece", "start_sec", "end_sec", "duration_sec", "focus",
        F.when(stock, F.lit(FALLBACK_LINE)).otherwise(F.col("line")).alias("line"),
    )


def _running(values: Column) -> Column:
    """Running sums of an array of doubles, the first value first."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def sums(lists: pa.Array) -> pa.Array:
        at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        own = [np.cumsum(x[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *own])))

    return sums(values)


def scenes_of_lines(
    scripts: DataFrame, key: str, lines: str, total: Column, scenes: int, min_seconds: float, piece_size: int = PIECE
) -> DataFrame:
    """``allocate_weighted`` and ``compress_groups`` for scripts that hold their lines in an array.

    Times, merging, pieces and stock lines are those of the two; all of it stays in the
    script's row, so no line is shuffled.
    """
    want = max(1, scenes)
    solid = F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")
    df = scripts.select(key, total.cast("double").alias("_total"), solid.alias("_t"))
    stock = F.when(F.col("_total") >= 6, F.array(F.lit(FALLBACK_LINE), F.lit(FALLBACK_CLOSE))).otherwise(F.array(F.lit(FALLBACK_LINE)))
    blank = F.size("_t") == 0
    df = df.select(key, "_total", blank.alias("_blank"), F.when(blank, stock).otherwise(F.col("_t")).alias("_t"))
    weight = lambda t: F.greatest(F.lit(0.8), F.regexp_count(t, F.lit(r"(?U)\S+")) * F.lit(0.35))
    df = df.withColumns({"_n": F.size("_t").cast("bigint"), "_w": F.transform("_t", weight), "_len": F.transform("_t", lambda t: (F.length(t) + 2).cast("double"))})
    df = df.withColumns({"_run": _running("_w"), "_upto": _running("_len")})

    floor = F.lit(max(0.4, float(min_seconds)))
    all_, n = F.col("_total"), F.col("_n")
    low = F.when(n * floor > all_, F.greatest(F.lit(0.1), all_ / n)).otherwise(floor)
    df = df.withColumn("_low", low)
    df = df.withColumns({"_budget": F.greatest(F.lit(0.0), all_ - n * F.col("_low")), "_sum": F.get("_run", F.size("_run") - 1)})

    def timed(run: Column, i: Column) -> Column:
        at = lambda i, w: F.least(all_, F.col("_low") * i + F.col("_budget") * (w / F.col("_sum")))
        step, last = all_ / n, i + 1 == n
        begin = F.when(F.col("_blank"), step * i).when(i == 0, F.lit(0.0)).otherwise(at(i, run - F.get("_w", i)))
        end = F.when(last, all_).when(F.col("_blank"), step * (i + 1)).otherwise(at(i + 1, run))
        rest = F.when(last & ~F.col("_blank"), F.round(all_ - F.round(begin, 3), 3)).otherwise(F.round(end - begin, 3))
        return F.struct(F.round(begin, 3).alias("a"), F.round(end, 3).alias("b"), rest.alias("d"))

    size = F.when(n > want, F.ceil(n / want)).otherwise(1).cast("bigint")
    df = df.withColumns({"_at": F.transform("_run", timed), "_size": size})
    df = df.withColumn("_groups", F.ceil(n / F.col("_size")).cast("bigint"))

    def merged(seg: Column) -> Column:
        own = F.slice("_at", ((seg - 1) * F.col("_size") + 1).cast("int"), F.col("_size").cast("int"))
        length = F.aggregate(own, F.lit(0.0), lambda s, x: s + x["d"])
        guess = F.greatest(F.lit(0.1), F.element_at(own, -1)["b"] - F.element_at(own, 1)["a"])
        return F.when(length > 0, length).otherwise(guess)

    # At most ``scenes`` of a script: their running sum is taken anew for each.
    df = df.withColumn("_dur", F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("_groups")), merged))

    def scene(dur: Column, i: Column) -> Column:
        run = F.aggregate(F.slice("_dur", F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x)
        start, end, last = F.least(all_, run - dur), F.least(all_, run), i + 1 == F.col("_groups")
        own, small = F.get("_at", i), n <= want
        first = i * F.col("_size")
        return F.struct(
            (i + 1).cast("bigint").alias("scene_index"),
            F.when(small, own["a"]).otherwise(F.round(start, 3)).alias("start_sec"),
            F.when(small, own["b"]).when(last, F.round(all_, 3)).otherwise(F.round(end, 3)).alias("end_sec"),
            F.when(small, own["d"]).when(last, F.round(all_ - F.round(start, 3), 3)).otherwise(F.round(end - start, 3)).alias("duration_sec"),
            F.slice("_t", (first + 1).cast("int"), F.col("_size").cast("int")).alias("_t"),
            F.transform(
                F.slice("_upto", (first + 1).cast("int"), F.col("_size").cast("int")), lambda upto: upto - F.coalesce(F.get("_upto", (first - 1).cast("int")), F.lit(0.0))
            ).alias("_upto"),
        )

    df = df.select(key, F.inline(F.transform("_dur", scene)))
    # The piece of a line, by the characters before it.
    place = F.transform("_upto", lambda upto, i: F.floor(F.coalesce(F.get("_upto", i - 1), F.lit(0.0)) / F.lit(piece_size)) + 1)
    df = df.withColumn("_piece", place).withColumn("piece", F.explode(F.array_distinct("_piece")))
    text = F.array_join(F.filter("_t", lambda t, i: F.get("_piece", i) == F.col("piece")), " ")
    return df.select(key, "scene_index", F.col("piece").cast("bigint").alias("piece"), "start_sec", "end_sec", "duration_sec", F.lit("").alias("focus"), text.alias("line"))


# ---- timing rules -------------------------------------------------------------------
def timing_class(
    df: DataFrame,
    raw: Column,
    video: Column,
    min_over: float = 0.8,
    preferred: float = 2.0,
    max_over: float = 2.8,
    stretch: bool = False,
) -> DataFrame:
    """How a narration fits its clip, and what to do about it."""
    lo = max(0.0, min_over)
    hi = max(lo, max_over)
    target = min(hi, max(lo, max(0.0, preferred)))
    reason = (
        F.when(raw > video + hi, "above_max_overrun")
        .when(raw < video + lo, "below_min_overrun")
        .when(raw >= video + target, "within_range_above_preferred")
        .when(raw > video, "within_range_below_preferred")
        .otherwise("at_or_below_video_duration")
    )
    if stretch:
        action, goal = F.lit("stretch"), video + target
    else:
        action = (
            F.when(raw > video + hi, "speed_to_max").when(raw < video + lo, "pad_to_min").otherwise("keep")
        )
        goal = F.when(raw > video + hi, video + hi).when(raw < video + lo, video + lo).otherwise(raw)
    return (
        df.withColumn("timing_reason", reason)
        .withColumn("coverage", F.round(raw / F.greatest(F.lit(0.001), video), 3))
        .withColumn("action", action)
        .withColumn("goal_sec", F.round(goal, 3))
    )


def label_by_windows(
    df: DataFrame, t: Column, windows: DataFrame, key: str, begin: str = "begin", end: str = "end",
    out: str = "labelled",
) -> DataFrame:
    """Is ``t`` inside one of the windows that ``windows`` has for the row's key?

    A negative or null end is open, an end before its start is raised to it; a key
    without windows is never labelled. The windows of one item are few and travel as one
    array, so rows meet them by a plain join that Spark can split on hot keys.
    """
    span = F.struct(F.greatest(F.lit(0.0), F.col(begin).cast("double")).alias("b"), F.col(end).cast("double").alias("e"))
    held = windows.groupBy(key).agg(F.collect_list(span).alias("_windows"))
    moment = t.cast("double")
    inside = F.exists("_windows", lambda w: (F.col("_t") >= w["b"]) & (
        w["e"].isNull() | (w["e"] < 0) | (F.col("_t") <= F.greatest(w["b"], w["e"]))
    ))
    return (
        df.withColumn("_t", moment).join(held, key, "left")
        .withColumn(out, F.coalesce(inside, F.lit(False))).drop("_t", "_windows")
    )


def label_windows(
    df: DataFrame, t: Column, windows: Sequence[tuple[float, float]], out: str = "labelled"
) -> DataFrame:
    """Is ``t`` inside one of the windows? A negative end is open; an end before its
    start is raised to it. Windows are job settings, hence literals, not a join."""
    tests = []
    for begin, end in windows:
        begin = max(0.0, begin)
        tests.append(t >= begin if end < 0 else t.between(begin, max(begin, end)))
    return df.withColumn(out, any_of(tests))
