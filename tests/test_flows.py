"""Whole jobs on small fixtures."""

import random

from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import queues as Q
from shelfspark.operators import sequence as S
from shelfspark.plans import flows
from shelfspark.profiles import UrlProfile


def test_link_table_starts_with_the_seed(spark):
    html = '<a href="/gp/bestsellers/toys/7">Seven</a><a href="/gp/bestsellers/toys/ref=x">root</a>'
    pages = spark.createDataFrame(
        [(0, "https://shop.example/gp/bestsellers/toys", html), (1, "https://shop.example/gp/bestsellers/x", html)],
        schemas.PAGES,
    )
    got = flows.link_table(
        pages, "Toys", "https://shop.example/gp/bestsellers/toys/ref=zg_bs_nav_toys_0", root="toys",
        site=UrlProfile(),
    ).orderBy("page_id", "pos").collect()
    assert [(r.branch_name, r.is_seed, r.depth) for r in got] == [("Toys", True, 0), ("Seven", None, 0)]


def test_inspect_keeps_the_input_order(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "<title>t</title>") for i in range(4)], schemas.PAGES)
    order = spark.createDataFrame([("u2", 0), ("u0", 1), ("u1", 2), ("u2", 9)], "url string, ord long")
    results, summary = flows.inspect_pages(pages, order)
    assert [r.url for r in results.collect()] == ["u0", "u1", "u2", "u3"]
    assert summary.first().total == 4


def test_publish_plan(spark):
    rows = [("b1", f"https://x/dp/AAAAAAAAA{i}", i) for i in range(6)]
    items = spark.createDataFrame(rows, "branch string, url string, pos long")
    url = lambda *n: spark.createDataFrame([(rows[i][1],) for i in n], "url string")
    skipped = url(2, 3).withColumn("item_key", F.right("url", F.lit(10)))
    ready = spark.createDataFrame([("AAAAAAAAA3",)], "item_key string")
    out = flows.publish_plan(items, url(0), url(0, 1), skipped, ready, "2024-01-01 18:00:00")
    plan = {r.pos: str(r.slot_at) for r in out["plan"].collect()}
    assert plan == {3: "2024-01-01 19:30:00", 4: "2024-01-02 11:30:00", 5: "2024-01-02 17:30:00"}
    p = out["progress"].first()
    assert (p.total, p.done, p.skipped, p.pending, p.next_item) == (6, 2, 1, 3, rows[3][1])


def test_script_segments(spark):
    text = "This pan heats fast and cleans easily. This pan heats fast and cleans easy. It saves time. Link in bio."
    df = spark.createDataFrame([(1, text), (2, "")], "id long, text string")
    got = flows.script_segments(df, "id", "text", F.lit(20.0), 3, opening="Look here", closing="Buy it").collect()
    one = sorted((r for r in got if r.id == 1), key=lambda r: r.scene_index)
    assert " ".join(r.line for r in one) == "Look here. This pan heats fast and cleans easily. It saves time. Buy it"
    assert len(one) <= 3 and one[-1].end_sec == 20.0 and one[0].start_sec == 0.0
    assert {r.id for r in got} == {1, 2}


def test_scripts_without_usable_lines_get_stock_lines(spark):
    df = spark.createDataFrame([(1, "Works. Well."), (2, " "), (3, None)], "id long, text string")
    got = flows.script_segments(df, "id", "text", F.lit(8.0), 3).collect()
    assert {r.id: len([x for x in got if x.id == r.id]) for r in got} == {1: 2, 2: 2, 3: 2}
    lines = spark.createDataFrame([(1, 0, ""), (2, 0, "one"), (2, 1, " ")], "id long, n long, line string")
    even = S.split_even(lines, "id", "n", "line", F.lit(4.0), 2).collect()
    assert sorted((r.id, r.scene_index) for r in even) == [(1, 1), (2, 1)]


def test_scene_texts_come_in_pieces(spark):
    """A hot script of many lines: no cell exceeds the piece by more than a line; joined, nothing is lost."""
    rows = [(1, i, f"line {i}" if i % 7 else " ") for i in range(900)] + [(2, 0, "alone")]
    lines = spark.createDataFrame(rows, "id long, n long, line string").repartition(4)
    even = S.split_even(lines, "id", "n", "line", F.lit(60.0), 3, chunk_width=50, piece_size=100)
    texts = {(r.id, r.scene_index): r.line for r in S.join_pieces(even, "id").collect()}
    solid = [t for i, _, t in rows if i == 1 and t.strip()]
    size = -(-len(solid) // 3)
    assert [texts[1, k + 1] for k in range(3)] == [" ".join(solid[k * size : (k + 1) * size]) for k in range(3)]
    cells = even.filter("id = 1").collect()
    assert max(len(r.line) for r in cells) < 110 and len(cells) > 60 and texts[2, 1] == "alone" and len(texts) == 5
    timed = S.allocate_weighted(lines, "id", "n", ["line"], F.lit(600.0), 0.4)
    merged = S.compress_groups(timed.withColumn("f", F.concat(F.lit("f"), "scene_index")), "id", 4, F.lit(600.0), "f", chunk_width=50, piece_size=100)
    assert max(len(r.line) + len(r.focus) for r in merged.collect()) < 130
    whole = {(r.id, r.scene_index): r for r in S.join_pieces(merged, "id").collect()}
    size = -(-len(solid) // 4)
    assert [whole[1, k + 1].line for k in range(4)] == [" ".join(solid[k * size : (k + 1) * size]) for k in range(4)]
    assert whole[1, 1].focus == " | ".join(f"f{i}" for i in range(1, size + 1)) and whole[1, 4].end_sec == 600.0


def test_choose_opening(spark):
    df = spark.createDataFrame([("", " ", None, "First one. Two.")], "a string, b string, c string, s string")
    pick = flows.choose_opening(F.col("a"), F.col("b"), F.col("c"), F.col("s"))
    assert df.select(pick).first()[0] == "First one."


def test_scripts_stay_in_their_rows(spark):
    """The timed scenes equal those of the operators on tables of lines, and no line is shuffled."""
    r = random.Random(5)
    rows = [(i, float(t), [r.choice(["one", "two words", " ", "a longer line of more words", ""]) for _ in range(k)]) for i, (t, k) in enumerate([(5, 0), (9, 0), (20, 1), (20, 3), (3, 9), (60, 25), (40, 200), (7, 6)])]
    df = spark.createDataFrame(rows, "id long, t double, lines array<string>")
    lines = df.select("id", "t", F.posexplode_outer("lines").alias("n", "line"))
    for scenes, size in ((3, 40), (1, 10_000), (6, 100)):
        got = S.scenes_of_lines(df, "id", "lines", F.col("t"), scenes, 1.2, size)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        timed = S.allocate_weighted(lines, "id", "n", ["line"], F.col("t"), 1.2).join(df.select("id", "t"), "id")
        want = S.compress_groups(timed, "id", scenes, F.col("t"), piece_size=size)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    out = flows.script_segments(df.withColumn("text", F.array_join("lines", ". ")), "id", "text", F.col("t"), 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_publish_plan_closes_items_without_grouping_their_keys(spark):
    """Repeated keys of state and log change nothing; the queue is made once and ranked as written."""
    items = spark.createDataFrame([("b", f"u{i}", i) for i in range(5)], "branch string, url string, pos long")
    url = lambda *n: spark.createDataFrame([(None if i is None else f"u{i}" if i >= 0 else "",) for i in n], "url string")
    skipped = url(2, 2, 3).withColumn("item_key", F.col("url"))
    ready = spark.createDataFrame([("u3",), ("u3",)], "item_key string")
    out = flows.publish_plan(items, url(0, 0, None), url(0, 1, 1, -1, None), skipped, ready, "2024-01-01 18:00:00")
    assert [(r.url, r.slot_no) for r in out["plan"].orderBy("slot_no").collect()] == [("u3", 1), ("u4", 2)]
    assert sorted(r.url or "" for r in out["uploaded"].collect()) == ["", "u0", "u1"]
    assert "LeftAnti" not in out["plan"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in Q.pending(items, url(0, 0), url(1), "url", ["branch"], ["pos"])._jdf.queryExecution().optimizedPlan().toString()
