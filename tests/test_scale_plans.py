"""Chunked plans give what one window per key gives, for any chunk size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.operators import graph as G
from shelfspark.operators import queues as Q
from shelfspark.operators import sequence as S
from shelfspark.plans import chunked

COLUMNS = "id long, k string, v long, x double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3_000):
        # A third of the rows share one key; some have none.
        k = "hot" if rng.random() < 0.34 else None if rng.random() < 0.05 else f"k{rng.randrange(20)}"
        data.append((i * 3, k, rng.randrange(-5, 9), rng.random()))
    rng.shuffle(data)
    return spark.createDataFrame(data, COLUMNS).repartition(5).cache()


def same(a, b, *cols):
    key = lambda r: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    left = sorted(key(r) for r in a.select(*cols).collect())
    assert left == sorted(key(r) for r in b.select(*cols).collect())


@pytest.mark.parametrize("width,fan", [(1, 2), (50, 3), (1_000, 1024)])
def test_running_matches_plain_window(rows, width, fan, monkeypatch):
    monkeypatch.setattr(chunked, "FAN", fan)
    got = chunked.running(
        rows, ["k"], ["id"], chunked.by_id("id", width), rank="r", sums={"s": F.col("v")},
        totals={"n": (F.sum, F.lit(1)), "lo": (F.min, F.col("v"))},
    )
    w = Window.partitionBy("k").orderBy("id")
    want = rows.select(
        "*", F.row_number().over(w).alias("r"), F.sum("v").over(w).alias("s"),
        F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"),
        F.min("v").over(Window.partitionBy("k")).alias("lo"),
    )
    same(got, want, "id", "k", "r", "s", "n", "lo")


def test_global_rank(rows):
    got = chunked.running(rows, [], ["id"], chunked.by_id("id", 100), rank="r")
    want = rows.withColumn("r", F.row_number().over(Window.orderBy("id")))
    same(got, want, "id", "r")


@pytest.mark.parametrize("width,fan", [(1, 2), (40, 3), (100_000, 1024)])
def test_previous_matches_lag(rows, width, fan, monkeypatch):
    monkeypatch.setattr(chunked, "FAN", fan)
    got = chunked.previous(rows, ["k"], ["id"], chunked.by_id("id", width), {"p": "v", "q": "id"})
    w = Window.partitionBy("k").orderBy("id")
    want = rows.select("*", F.lag("v").over(w).alias("p"), F.lag("id").over(w).alias("q"))
    same(got, want, "id", "p", "q")


@pytest.mark.parametrize("width", [1, 4, 40, 100_000])
def test_two_rows_back_and_smoothing_in_one_pass(rows, width):
    back = [{"p": "v", "q": "id"}, {"p2": "v", "q2": "id"}]
    got = chunked.swept(rows, ["k"], ["id"], chunked.by_id("id", width), back, ("x", 0.3, "s"))
    w = Window.partitionBy("k").orderBy("id")
    want = rows.select("*", F.lag("v").over(w).alias("p"), F.lag("id").over(w).alias("q"), F.lag("v", 2).over(w).alias("p2"), F.lag("id", 2).over(w).alias("q2"))
    same(got, want, "id", "k", "v", "x", "p", "q", "p2", "q2")
    alone = chunked.swept(rows, [], ["id"], chunked.by_id("id", width), back)
    w = Window.orderBy("id")
    same(alone, rows.select("*", F.lag("v").over(w).alias("p"), F.lag("id", 2).over(w).alias("q2")), "id", "p", "q2")


def test_load_metrics_moves_rows_once(rows):
    """Two exchanges of rows (all columns; the needed ones) and one of chunks; the plan's size is fixed."""
    ticks = rows.selectExpr("timestamp_seconds(id) AS ts", "k", "v AS responses", "0 AS errors", "x AS cpu", "x AS ram", "x AS gpu")
    plan = S.load_metrics(ticks, "k", ["ts"], 3600.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 4
    sizes = []
    for n in (10, 1000):
        chunk = chunked.by_quantiles(rows, "id", 3000 // n)
        sizes.append(len(rows.select(chunk.alias("c"))._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 20


@pytest.mark.parametrize("alpha", [0.35, 0.05])
@pytest.mark.parametrize("width,fan", [(1, 2), (40, 3), (100_000, 1024)])
def test_smoothed_matches_walk(rows, width, fan, alpha, monkeypatch):
    monkeypatch.setattr(chunked, "FAN", fan)
    got = {
        r.id: r.s
        for r in chunked.smoothed(rows, ["k"], ["id"], chunked.by_id("id", width), "x", alpha, "s").collect()
    }
    state = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        state[r.k] = state.get(r.k, 0.0) * (1 - alpha) + r.x * alpha
        assert got[r.id] == pytest.approx(state[r.k], abs=1e-12)


@pytest.mark.parametrize("width", [1, 30, 100_000])
def test_queue_cursor_matches_walk(rows, width):
    took, failed = F.col("v") > 3, F.col("v") < 0
    got = {r.k: r.cursor for r in
           Q.queue_cursor(rows, "k", ["id"], chunked.by_id("id", width), took, failed).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.id):
        step = 1 if r.v > 3 else -1 if r.v < 0 else 0
        want[r.k] = max(0, want.get(r.k, 0) + step)
    assert got == want


def test_hot_key_is_limited_before_the_shuffle(rows):
    plan = Q.top_n_per_key(rows, ["k"], ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("WindowGroupLimit") >= 2


def test_reach_over_a_hub(spark):
    links = [(i, "/hub") for i in range(300)] + [(300, "/a"), (301, "/a"), (299, "/a"), (302, "/z")]
    edges = G.shared_target_edges(spark.createDataFrame(links, "p long, h string"), "p", "h")
    seed = spark.createDataFrame([("s:0",)], "node string")
    got = {r.node: r.depth for r in G.reach(edges, seed, 10).collect() if r.node.startswith("s:")}
    assert len(got) == 302 and got["s:1"] == 2 and got["s:300"] == 4 and "s:302" not in got
    assert G.reach(edges, seed, 10, max_nodes=5).count() == 5


@pytest.mark.parametrize("values", [
    [0] + [10**12 + i for i in range(2_000)],  # one outlier
    [i // 10 if i < 1_000 else i * 1_000_003 for i in range(2_000)],  # a burst
    [(i * 0x9E3779B97F4A7C15) % 2**62 for i in range(2_000)],  # ids like hashes
])
def test_quantile_chunks_bound_the_work(spark, values):
    rows = spark.createDataFrame([(v, "hot") for v in values], "id long, k string").repartition(4)
    chunk = chunked.by_quantiles(rows, "id", 100)
    sizes = [r["count"] for r in rows.groupBy(chunk.alias("c")).count().collect()]
    assert max(sizes) <= 200 and len(sizes) >= 15
    got = chunked.running(rows, ["k"], ["id"], chunk, rank="r")
    w = Window.partitionBy("k").orderBy("id")
    if len(set(values)) == len(values):
        same(got, rows.withColumn("r", F.row_number().over(w)), "id", "r")


def test_quantile_chunks_of_times_and_nothing(spark):
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    n = [r["count"] for r in rows.groupBy(chunked.by_quantiles(rows, "ts", 50).alias("c")).count().collect()]
    assert 7 <= len(n) <= 13 and max(n) <= 100
    none = rows.where("false")
    assert none.groupBy(chunked.by_quantiles(none, "ts", 50).alias("c")).count().count() == 0
