"""Files in, files out, and streams that arrive in several batches."""

import json

import pytest
from pyspark.sql import functions as F

from shelfspark import schemas
from shelfspark.operators import pages as P
from shelfspark.operators import queues as Q
from shelfspark.plans import chunked
from shelfspark.sources import logs, records, reports, state
from shelfspark.sources.tables import read_pages
from shelfspark.streaming import jobs as J


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_url_list_shapes(spark, tmp_path):
    shapes = {
        "a": json.dumps([" u1 ", "u2", "u1", 5]),
        "b": json.dumps([{"url": "a", "product_url": "b"}, {"url": "c"}, {"product_url": " ", "url": "d"}]),
        "c": json.dumps({"results": [{"url": "a", "product_url": "b"}, "skip", {"product_url": "e"}]}),
        "d": json.dumps({"urls": ["x", " ", "y"]}),
        "e": "﻿l1\r\n\n l2 \nl1\n[",
        "f": json.dumps({"other": 1}),
    }
    got = {}
    for name, text in shapes.items():
        path = write(tmp_path / f"{name}.json", text)
        got[name] = [r.url for r in records.read_url_list(spark, path).orderBy("ord").collect()]
    assert got["a"][:2] == ["u1", "u2"]
    assert got["b"] == ["b", "c", "d"]
    assert got["c"] == ["a", "e"]
    assert got["d"] == ["x", "y"]
    assert got["e"] == ["l1", "l2", "["]
    assert got["f"] == []


def test_url_lines(spark, tmp_path):
    path = write(tmp_path / "lines.txt", "b\na\n\nb\n c \n")
    got = records.read_url_lines(spark, path).orderBy("ord").collect()
    assert [r.url for r in got] == ["b", "a", "c"]


def test_records(spark, tmp_path):
    ok = [{"branch_name": "n", "branch_url": "u", "depth": 2, "extra": 1}, "x", {"branch_url": " "}, 7]
    path = write(tmp_path / "r.json", json.dumps(ok))
    got = records.read_records(spark, path, schemas.BRANCH, "branch_url").collect()
    assert [(r.ord, r.branch_name, r.branch_url, r.depth, r.is_seed) for r in got] == [(0, "n", "u", 2, None)]
    for i, text in enumerate(['{"branch_url":"u"}', "not json", ""]):
        bad = write(tmp_path / f"bad{i}.json", text)
        assert records.read_records(spark, bad, schemas.BRANCH, "branch_url").count() == 0


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("u1", "y1", "t")], schemas.UPLOAD_LOG)
    logs.append_log(rows, path)
    logs.append_log(rows, path)
    write(tmp_path / "log" / "part-x.json", "\n{broken\n{\"url\":\"\"}\n[1]\n")
    assert [r.url for r in logs.read_jsonl_log(spark, path).collect()] == ["u1", "u1"]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(0, "https://a/dp/B07WMS7TWB", "http://m.example/a.mp4 "), (1, "https://b/", "captcha")],
                               schemas.PAGES)
    results = P.page_results(df)
    for fmt in ("parquet", "json"):
        reports.write_report(results, str(tmp_path / fmt), fmt)
        detail, summary = reports.read_report(spark, str(tmp_path / fmt), fmt)
        s = summary.first()
        assert (detail.count(), s.total, s.with_video, s.without_video, s.downloaded_videos) == (2, 2, 1, 1, 0)
    reports.write_urls(results, str(tmp_path / "urls"))
    assert spark.read.text(str(tmp_path / "urls")).count() == 2


def test_state_defaults_and_round_trip(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps(
        {"branch_index": 2, "uploaded_urls": ["a"], "upload_error_by_url": {"b": "x"}, "unknown": 1}))
    tables = state.import_state(spark, path)
    scalars = tables["scalars"].first()
    assert (scalars.branch_index, scalars.product_index, scalars.last_upload_time) == (2, 0, "")
    state.save_state(tables, str(tmp_path / "state"))
    back = state.load_state(spark, str(tmp_path / "state"))
    assert [r.url for r in back["uploaded"].collect()] == ["a"]
    assert back["skipped"].count() == 0
    assert [(r.url, r.error) for r in back["errors"].collect()] == [("b", "x")]


NASTY = [
    {"branch_name": 'a "quoted, [{" \\', "branch_url": "u,1"}, "x, [", 7, None, [1, {"a": [2, "]}"]}], {"branch_name": "\\\\", "branch_url": "é,日,本"},
    {"branch_name": "n" * 300 + ",", "branch_url": "long"}, {}, {"branch_url": " "}, {"branch_url": "last", "depth": 3},
]


@pytest.mark.parametrize("size", [64, 100_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_split_between_tasks(spark, tmp_path, size, indent):
    """The same rows however small the splits are, in strings, brackets and escapes."""
    rows = NASTY * 4
    write(tmp_path / "a.json", "\ufeff " + json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    write(tmp_path / "b.json", json.dumps(rows[:5]))
    for i, text in enumerate(['{"branch_url":"u"}', "not, json", "", "[]", '[{"branch_url":"u"}', '["a]', '[1]]']):
        write(tmp_path / f"bad{i}.json", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        elements, objects, lines = records.read_elements(spark, str(tmp_path))
        got = sorted((r.file.rsplit("/", 1)[1], r.ord, r.element) for r in elements.collect())
        want = [("a.json", i, x) for i, x in enumerate(rows)] + [("b.json", i, x) for i, x in enumerate(rows[:5])]
        assert [(f, o, json.loads(t)) for f, o, t in got] == want
        assert len(objects) == 4 and [f.rsplit("/", 1)[1] for f in lines] == ["bad1.json"]
        if size == 64:
            assert spark.read.text(str(tmp_path / "a.json"), lineSep=",").rdd.getNumPartitions() > 20
        kept = records.read_records(spark, str(tmp_path), schemas.BRANCH, "branch_url")
        urls = [x["branch_url"] for x in rows if isinstance(x, dict) and x.get("branch_url", " ").strip()]
        assert [r.branch_url for r in kept.orderBy("file", "ord").collect()][: len(urls)] == urls
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_url_lists(spark, tmp_path):
    made = [f"http://a/{i},{i}" for i in range(200)]
    write(tmp_path / "1.json", json.dumps({"results": [{"url": u, "x": [1, 2]} for u in made[:80]]}))
    write(tmp_path / "2.json", json.dumps({"urls": made[60:150]}, indent=1))
    write(tmp_path / "3.json", json.dumps({"n": 3, "urls": made[140:160]}))
    write(tmp_path / "4.txt", "\r\n".join(made[150:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    try:
        got = [r.url for r in records.read_url_list(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(made)


EVENTS = "id long, k string, kind string, ts timestamp, cpu double, ram double, gpu double"


def events(spark, tmp_path, batches=4):
    """A stream directory with one file per batch, in time order, and the whole table."""
    data = spark.range(400).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.hash("id") % 3 == 0, "fail").otherwise("take").alias("kind"),
        F.timestamp_seconds(F.col("id") * 37).alias("ts"),
        *[(F.col("id") * n % 100).cast("double").alias(g) for g, n in (("cpu", 7), ("ram", 11), ("gpu", 13))],
    )
    path = str(tmp_path / "in")
    for b in range(batches):
        data.filter(F.floor(F.col("id") / (400 / batches)) == b).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, data


def test_dedupe_stream(spark, tmp_path):
    stream, data = events(spark, tmp_path)
    out = J.run_to_table(J.stream_dedupe(stream.select("k", "kind", "ts"), ["k", "kind"]), str(tmp_path / "o1"))
    assert out.count() == data.select("k", "kind").distinct().count()
    bounded = J.stream_dedupe(stream.select("k", "kind", "ts"), ["k", "kind"], "ts", "1 day")
    assert J.run_to_table(bounded, str(tmp_path / "o2")).count() == out.count()


def feed(data, path, batches, total=4):
    """Those of ``total`` parts of ``data``, in id order, one file each."""
    for b in batches:
        data.filter(F.floor(F.col("id") / (400 / total)) == b).coalesce(1).write.mode("append").parquet(path)


def rerun(spark, tmp_path, job):
    """``job(stream)`` on two parts of the events, then from its checkpoint on all four; the last result."""
    stream, data = events(spark, tmp_path)
    path = str(tmp_path / "late")
    feed(data, path, (0, 1))
    late = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    job(late).collect()
    feed(data, path, (2, 3))
    return job(late), data


def rows_of(df):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_merge_log_goes_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "merged")
    earlier = spark.createDataFrame([("k1",), ("old",), ("",)], "k string")
    merged, data = rerun(spark, tmp_path, lambda s: J.stream_merge_log(s.select("k"), path, "k", J.seed_state(earlier, f"{path}-seed")))
    assert sorted(r.k for r in merged.collect()) == sorted({r.k for r in data.collect()} | {"old"})
    # The whole log replayed under a new name adds nothing.
    data.coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    late = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "late"))
    again = J.stream_merge_log(late.select("k"), path, "k", J.seed_state(earlier, f"{path}-seed"))
    assert again.count() == merged.count()


def test_merge_log_without_a_seed(spark, tmp_path):
    stream, data = events(spark, tmp_path)
    merged = J.stream_merge_log(stream.select("k"), str(tmp_path / "state"), "k")
    assert sorted(r.k for r in merged.collect()) == sorted({r.k for r in data.collect()})


def test_cursor_stream_equals_batch_after_a_restart(spark, tmp_path):
    took, failed = F.col("kind") == "take", F.col("kind") == "fail"
    got, data = rerun(spark, tmp_path, lambda s: J.stream_queue_cursor(s, str(tmp_path / "o"), "k", ["ts", "id"], took, failed))
    want = Q.queue_cursor(data, "k", ["ts", "id"], chunked.by_time("ts", 600), took, failed)
    assert rows_of(got) == rows_of(want)
    changed = spark.read.parquet(str(tmp_path / "o"))
    assert changed.select("batch").distinct().count() == 4


def test_cursor_starts_from_earlier_counters(spark, tmp_path):
    seed = J.seed_state(spark.createDataFrame([("hot", 50, 3, 40), ("gone", 7, 1, 6)], "k string, taken long, failures long, cursor long"), str(tmp_path / "seed"))
    took, failed = F.col("kind") == "take", F.col("kind") == "fail"
    got, data = rerun(spark, tmp_path, lambda s: J.stream_queue_cursor(s, str(tmp_path / "o"), "k", ["ts", "id"], took, failed, seed))
    cursor, taken, fails = 40, 50, 3
    for r in data.filter("k = 'hot'").orderBy("id").collect():
        cursor, taken, fails = max(0, cursor + (1 if r.kind == "take" else -1)), taken + (r.kind == "take"), fails + (r.kind == "fail")
    found = {r.k: (r.taken, r.failures, r.cursor) for r in got.collect()}
    assert found["hot"] == (taken, fails, cursor) and found["gone"] == (7, 1, 6) and len(found) == 9


GAUGES = ["cpu", "ram", "gpu"]
TICK_COLUMNS = ["k", "tick", "responses", "errors", *GAUGES, "rps", "error_rate", "smoothed", "brake", "throughput_drop"]


def tick_stream(stream, path, end):
    return J.stream_tick_metrics(stream, path, "k", "ts", F.col("kind") == "fail", GAUGES, 600, "1 hour", end=end).select(TICK_COLUMNS)


def test_tick_stream_equals_batch(spark, tmp_path):
    stream, data = events(spark, tmp_path)
    got = tick_stream(stream, str(tmp_path / "o"), True)
    want = J.tick_metrics(J.tick_counts(data, "k", "ts", F.col("kind") == "fail", GAUGES, "10 minutes"), "k", 600)
    assert rows_of(got) == rows_of(want.select(TICK_COLUMNS)) and want.count() > 60


def test_tick_stream_keeps_open_slices_for_the_next_run(spark, tmp_path):
    got, data = rerun(spark, tmp_path, lambda s: tick_stream(s, str(tmp_path / "o"), False))
    want = J.tick_metrics(J.tick_counts(data, "k", "ts", F.col("kind") == "fail", GAUGES, "10 minutes"), "k", 600).select(TICK_COLUMNS)
    early, all_ = rows_of(got), rows_of(want)
    assert set(early) < set(all_) and len(early) == len(set(early))
    held = J.read_state(spark, str(tmp_path / "o")).select(F.size("value.groupState.ticks").alias("n")).collect()
    assert sum(r.n for r in held) == len(all_) - len(early) and max(r.n for r in held) <= 8
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    assert rows_of(tick_stream(stream, str(tmp_path / "o"), True)) == all_


def test_progress_rows_per_batch(spark, tmp_path):
    stream, data = events(spark, tmp_path)
    counts = J.stream_kept_counts(stream.select("k", "kind"), ["k", "kind"], str(tmp_path / "o")).orderBy("batch").collect()
    assert [r.original for r in counts] == [100] * 4 and counts[0].kept > 0 and all(r.removed == r.original - r.kept for r in counts)
    assert sum(r.kept for r in counts) == data.select("k", "kind").distinct().count()


def test_page_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"https://a/dp/B07WMS7TW{i}", f"<title>t&copy;{i}</title> http://m.example/{i}.mp4 ") for i in range(6)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, schemas.PAGES).repartition(3).write.parquet(path)
    counts = str(tmp_path / "counts")
    got = J.stream_page_results(read_pages(spark, path, streaming=True), str(tmp_path / "o"), progress=counts)
    want = P.page_results(read_pages(spark, path))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    seen = J.read_progress(spark, counts).groupBy().sum("pages", "with_video", "without_video").first()
    assert tuple(seen) == (6, 6, 0)


def test_pages_of_a_batch_arrive_in_several_files(spark, tmp_path):
    """A quarter of the table is one batch but not one file: its pages spread over tasks."""
    from shelfspark.registry import streams

    rows = [(i, f"https://shop.example/p/{i}", "<title>x</title>") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    seen = {}

    def scratch(_, name):
        seen[name] = str(tmp_path / name)
        return seen[name]

    given, streams.scratch_path = streams.scratch_path, scratch
    try:
        counts = streams.page_progress(spark, str(tmp_path)).collect()
    finally:
        streams.scratch_path = given
    assert [r.pages for r in counts] == [10] * 4
    assert len(spark.read.parquet(seen["arriving"]).inputFiles()) > 4
