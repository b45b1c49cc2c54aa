"""Incremental forms of the batch operators.

Sinks are written tables, never memory. What a job has to remember stands in the engine's
state store under the query's checkpoint: keys seen, counters, open time slices. A batch
touches the state of its own keys, and one that runs again after a failure starts from
the state before it. ``foreachBatch`` writers put each micro-batch under its own
``batch=<id>`` folder, so it replaces its own output.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

from shelfspark.functions.core import epoch_micros
from shelfspark.operators import pages as P
from shelfspark.operators import sequence as S
from shelfspark.plans import chunked
from shelfspark.session import checkpoint_root


def run_to_table(
    stream: DataFrame, path: str, mode: str = "append",
    batch: Callable[[DataFrame, int], None] | None = None, progress: str | None = None,
) -> DataFrame:
    """Process all available input into ``path`` and read it back."""
    run_stream(stream, path, mode, batch, progress)
    return stream.sparkSession.read.parquet(path)


def run_stream(
    stream: DataFrame, path: str, mode: str = "append",
    batch: Callable[[DataFrame, int], None] | None = None, progress: str | None = None,
) -> None:
    """Process all available input into ``path``.

    The query's own checkpoint lies next to the table, in the shared folder. What the stream
    observes (see ``DataFrame.observe``) is appended to the table ``progress`` while it runs.
    """
    spark = stream.sparkSession
    checkpoint_root(spark)
    name = f"q{uuid.uuid4().hex}"
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{path}-progress")
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path)
    if progress is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    listener = _Progress(name)
    spark.streams.addListener(listener)
    try:
        query = writer.trigger(availableNow=True).start()
        try:
            while not query.awaitTermination(PROGRESS_SECONDS):
                listener.flush(spark, progress)
        finally:
            listener.ended.wait(60)
            listener.flush(spark, progress)
    finally:
        spark.streams.removeListener(listener)


# ---- progress: a row of counts per batch ----------------------------------------------
#: How often the rows of ended batches are written.
PROGRESS_SECONDS = 10


class _Progress(StreamingQueryListener):
    """What one query observes, batch by batch, until it is written."""

    def __init__(self, name: str):
        self.name, self.run, self.rows, self.ended = name, None, [], threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name and p.numInputRows:
            seen = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
            self.rows.append({"batch": p.batchId, "input_rows": p.numInputRows, **seen})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()

    def flush(self, spark: SparkSession, path: str) -> None:
        rows, self.rows = self.rows, []
        if rows:
            kinds = ", ".join(f"`{c}` long" for c in rows[0])
            spark.createDataFrame([tuple(int(v) for v in r.values()) for r in rows], kinds).write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch; of a batch that ran twice the later counts (they are the same)."""
    return spark.read.parquet(path).dropDuplicates(["batch"])


# ---- dedupe ----------------------------------------------------------------------
def stream_dedupe(stream: DataFrame, keys: list[str], ts: str | None = None,
                  delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen before.

    With ``ts`` the memory of keys is bounded by a watermark; without, keys are
    remembered for good.
    """
    if ts is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_kept_counts(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Deduplicates a stream into ``path``; (batch, original, kept, removed) of each batch."""
    rows = stream.observe("read", F.count(F.lit(1)).alias("original"))
    kept = stream_dedupe(rows, keys).observe("written", F.count(F.lit(1)).alias("kept"))
    run_stream(kept, path, progress=f"{path}-counts")
    counts = read_progress(stream.sparkSession, f"{path}-counts")
    return counts.select("batch", "original", "kept", (F.col("original") - F.col("kept")).alias("removed"))


# ---- log into state -----------------------------------------------------------------
def seed_state(state: DataFrame, path: str) -> DataFrame:
    """A batch table put under ``path`` as the first input of a stateful query; the stream of it.

    The query reads it once, in its first batch. An empty table is a seed too.
    """
    state.write.mode("ignore").parquet(path)
    return state.sparkSession.readStream.schema(state.schema).parquet(path)


def stream_merge_log(log: DataFrame, path: str, key: str = "url", seed: DataFrame | None = None) -> DataFrame:
    """The keys of ``seed`` and of a log stream, each once, in the table at ``path`` (column ``key``).

    ``seed`` is a stream of earlier keys (see ``seed_state``). Which keys are known stands in
    the engine's own state, spread over its partitions by key and restored by its
    checkpoint, so a batch costs what its own keys cost and one that runs again adds nothing.
    """
    known = log.select(key)
    if seed is not None:
        known = seed.select(key).unionByName(known)
    known = known.filter(F.length(F.col(key).cast("string")) > 0)
    return run_to_table(known.dropDuplicates([key]), path)


# ---- ticks ------------------------------------------------------------------------------
def tick_counts(events: DataFrame, source: str, ts: str, is_error: Column, gauges: list[str], width: str) -> DataFrame:
    """Responses, errors and mean gauges per source and fixed time slice of stored events."""
    return (
        events.groupBy(source, F.window(ts, width).alias("w"))
        .agg(
            F.count_if(~is_error).alias("responses"),
            F.count_if(is_error).alias("errors"),
            *[F.avg(g).alias(g) for g in gauges],
        )
        .select(source, F.col("w.start").alias("tick"), "responses", "errors", *gauges)
    )


# A source has one row per tick, so this many rows make a chunk.
TICKS_PER_CHUNK = 65_536


def tick_metrics(ticks: DataFrame, source: str, seconds: float) -> DataFrame:
    """Rates, smoothed pressure and load class of a tick table.

    Counts of a slice are deltas already, so the rates need no previous row.
    """
    df = ticks.withColumn("rps", F.col("responses") / F.lit(seconds)).withColumn(
        "error_rate",
        F.col("errors") / F.greatest(F.lit(1), F.col("responses") + F.col("errors")),
    )
    df = df.withColumn("x", S.pressure(F.col("cpu"), F.col("ram"), F.col("gpu")))
    chunk = chunked.by_time("tick", seconds * TICKS_PER_CHUNK)
    df = chunked.swept(df, [source], ["tick"], chunk, [{"previous_rps": "rps"}], ("x", 0.35, "smoothed"))
    return S.load_class(df, source, ["tick"])


def _partial_slices(source: str, gauges: list[str], micros: int):
    """Sums per source and slice of each Arrow batch: what is shuffled is no longer rows."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["tick"] = rows["micros"] // micros * micros
            for g in gauges:
                rows[f"n_{g}"] = rows[g].notna().astype("int64")
            added = rows.drop(columns="micros").groupby([source, "tick"], dropna=False, sort=False).sum()
            yield added.reset_index()

    return sums


def _smoother(gauges: list[str], micros: int, alpha: float):
    """One source's open slices and what its last closed one left: rates and smoothed load.

    Slices are closed in order, once the watermark has passed their end.
    """
    values = ["responses", "errors", *[x for g in gauges for x in (g, f"n_{g}")]]

    def closed(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rps, smoothed, ticks, sums = state.get if state.exists else (None, 0.0, [], [])
        open_ = dict(zip(ticks, (sums[i : i + len(values)] for i in range(0, len(sums), len(values))), strict=True))
        for part in rows:
            for tick, *more in zip(*(part[c].tolist() for c in ("tick_us", *values)), strict=True):
                held = open_.get(tick)
                open_[tick] = list(map(float, more)) if held is None else [a + b for a, b in zip(held, more, strict=True)]
        past = state.getCurrentWatermarkMs() * 1000
        out = []
        for tick in sorted(t for t in open_ if t + micros <= past):
            responses, errors, *more = open_.pop(tick)
            means = [more[i] / more[i + 1] if more[i + 1] else None for i in range(0, len(more), 2)]
            if responses or errors:
                load = sum(w * m / 100 for w, m in zip(S.PRESSURE, means, strict=True)) if None not in means else 0.0
                smoothed, before, rps = smoothed * (1 - alpha) + load * alpha, rps, responses / (micros / 1e6)
                out.append((key[0], tick, int(responses), int(errors), *means, rps, before, smoothed))
        state.update((rps, smoothed, list(open_), [v for held in open_.values() for v in held]))
        if open_:
            # A timer may not lie behind the watermark.
            state.setTimeoutTimestamp(max(-(-(min(open_) + micros) // 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            whole, real = ["source", "tick_us", "responses", "errors"], [*gauges, "rps", "previous_rps", "smoothed"]
            columns = dict(zip([*whole, *real], zip(*out, strict=True), strict=True))
            yield pd.DataFrame({c: np.array(v, dtype="float64") if c in real else list(v) for c, v in columns.items()})

    return closed


def stream_tick_metrics(
    stream: DataFrame, path: str, source: str, ts: str, is_error: Column, gauges: list[str],
    seconds: float, delay: str, alpha: float = 0.35, end: bool = False,
) -> DataFrame:
    """Rates, smoothed pressure and load class per source and time slice, in the table at ``path``.

    ``gauges`` are the cpu, ram and gpu columns. Each Arrow batch is summed by slice before the shuffle; a source's
    state is its open slices, which the watermark bounds, with the rate and smoothed load of
    the last closed one. A slice is written when an event-time timer closes it, and never
    again; rows later than the watermark are dropped. With ``end`` the stream is taken to be
    complete: a closing row then moves the watermark past all slices. Without it the open
    ones wait in the state for the next run.
    """
    spark, micros = stream.sparkSession, int(seconds * 1_000_000)
    keyed = stream.select(
        source, epoch_micros(ts).alias("micros"), (~is_error).cast("long").alias("responses"), is_error.cast("long").alias("errors"),
        *[F.col(g).cast("double").alias(g) for g in gauges],
    ).filter("micros is not null")
    kinds = ", ".join(f"{g} double, n_{g} long" for g in gauges)
    name = f"`{source}` {stream.schema[source].dataType.simpleString()}"
    part = f"{name}, tick long, responses long, errors long, {kinds}"
    order = [source, "tick", "responses", "errors", *[x for g in gauges for x in (g, f"n_{g}")]]
    parts = keyed.mapInPandas(lambda b: (p[order] for p in _partial_slices(source, gauges, micros)(b)), part)
    closing = seed_state(spark.createDataFrame([], part), f"{path}-closing")
    parts = parts.unionByName(closing).withColumnRenamed("tick", "tick_us")
    # A row is late when its slice is closed: the watermark follows the ends of slices, not rows.
    parts = parts.withColumn("tick", F.timestamp_micros(F.col("tick_us") + F.lit(micros))).withWatermark("tick", f"{delay} {micros // 1000} milliseconds")
    out = f"{name}, tick_us long, responses long, errors long, " + ", ".join(f"{g} double" for g in gauges) + ", rps double, previous_rps double, smoothed double"
    metrics = parts.groupBy(source).applyInPandasWithState(
        _renamed(_smoother(gauges, micros, alpha), source), out,
        "rps double, smoothed double, ticks array<long>, sums array<double>", "append", "EventTimeTimeout",
    )
    found = run_to_table(metrics, path)
    if end:
        last = [(None, CLOSED_US, 0, 0, *[v for _ in gauges for v in (0.0, 0)])]
        spark.createDataFrame(last, part).write.mode("append").parquet(f"{path}-closing")
        found = run_to_table(metrics, path)
    errors = F.col("errors") / F.greatest(F.lit(1), F.col("responses") + F.col("errors"))
    found = found.withColumn("tick", F.timestamp_micros("tick_us")).withColumn("error_rate", errors).drop("tick_us")
    return S.load_class(found, source, ["tick"])


#: The time of a closing row, beyond any slice: the year 2250 (timestamps in Python end with 2262).
CLOSED_US = 8_835_955_200_000_000


def _renamed(closed, source: str):
    return lambda key, rows, state: (p.rename(columns={"source": source}) for p in closed(key, rows, state))


# ---- queue cursor ---------------------------------------------------------------------
COUNTERS = ("taken", "failures", "cursor")


def _cursor(order: list[str]):
    """A branch's counters after the rows of one batch, in their order; seed rows come first."""

    def moved(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counters = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(rows))
        taken, failures, cursor = (n + int(rows.loc[rows["seeded"], c].sum()) for n, c in zip(counters, COUNTERS, strict=True))
        steps = rows[~rows["seeded"]].sort_values(order)["step"].to_numpy(dtype="int64")
        if len(steps):
            # A cursor that stops at 0 ends where its steps lead, raised by what they lack on the way.
            run = np.cumsum(steps)
            taken, failures = taken + int((steps > 0).sum()), failures + int((steps < 0).sum())
            cursor = int(max(cursor + run[-1], run[-1] - min(0, run.min())))
        state.update((taken, failures, cursor))
        yield pd.DataFrame([(key[0], taken, failures, cursor)], columns=["key", *COUNTERS])

    return moved


def stream_queue_cursor(
    updates: DataFrame, path: str, key: str, order: list[str], took: Column, failed: Column, seed: DataFrame | None = None,
) -> DataFrame:
    """Cursor per branch (key, taken, failures, cursor), brought forward batch by batch.

    The counters stand in the engine's keyed state; ``seed`` is a stream of earlier counters
    (see ``seed_state``), which start the state in the first batch. Rows of one batch count
    in ``order``, batches in their own; a batch holds its own rows of one branch in one task,
    so the stream's ``maxFilesPerTrigger`` bounds it. The table at ``path`` gets the branches
    that a batch changed, under the batch's number; what is returned is the state itself.
    """
    step = F.when(took, 1).when(failed, -1).otherwise(0)
    by = [f"o{i}" for i in range(len(order))]
    none = [F.lit(0).cast("long").alias(c) for c in COUNTERS]
    rows = updates.select(F.col(key).alias("key"), F.lit(False).alias("seeded"), *[F.col(c).alias(n) for c, n in zip(order, by, strict=True)], step.alias("step"), *none)
    if seed is not None:
        blank = [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in by]
        rows = rows.unionByName(seed.select(F.col(key).alias("key"), F.lit(True).alias("seeded"), *blank, F.lit(0).alias("step"), *[F.col(c).cast("long").alias(c) for c in COUNTERS]))
    counters = ", ".join(f"{c} long" for c in COUNTERS)
    kind = updates.schema[key].dataType.simpleString()
    moved = rows.groupBy("key").applyInPandasWithState(_cursor(by), f"key {kind}, {counters}", counters, "update", "NoTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_stream(moved, path, "update", write)
    return read_state(updates.sparkSession, path).select(F.col("key.key").alias(key), *[f"value.groupState.{c}" for c in COUNTERS])


def read_state(spark: SparkSession, path: str, operator: int = 0) -> DataFrame:
    """(key, value) of the state of the query that wrote ``path``, as of its last batch."""
    return spark.read.format("statestore").option("operatorId", operator).load(f"{path}-progress")


# ---- pages --------------------------------------------------------------------------------
def observed_results(pages: DataFrame, page=P.PAGE, site=P.SITE) -> DataFrame:
    """Page results that are counted while they are written: pages, those with and without
    media, blocked pages and pages with an error."""
    return P.page_results(pages, page, site).observe(
        "pages", F.count(F.lit(1)).alias("pages"), F.count_if("has_video").alias("with_video"),
        F.count_if(~F.col("has_video")).alias("without_video"), F.count_if("blocked").alias("blocked"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def stream_page_results(
    pages: DataFrame, path: str, page=P.PAGE, site=P.SITE, progress: str | None = None
) -> DataFrame:
    """Page results as pages arrive.

    With ``progress`` that table gets a row of counts per batch while the stream runs.
    """
    return run_to_table(observed_results(pages, page, site), path, progress=progress)
