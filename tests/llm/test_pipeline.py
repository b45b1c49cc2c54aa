"""The corpus pipeline stage by stage against plain versions."""

import os

import pytest

import corpus_pipeline
from tests.llm.test_dedup import removed
from tests.llm.test_near_copies import kept_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen.append(docs.collect())
    clean, single, cut, final = seen[1:]
    rows = [(r.doc_id, r.text) for r in clean]
    assert sorted(r.doc_id for r in single) == kept_of(rows)
    counts = {r[0]: r[1] - r[2] for r in removed([(r.doc_id, r.text) for r in single], 35)}
    assert {r.doc_id: len((r.text or "").split()) for r in cut} == counts
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    assert not any(i in (r.text or "") for r in final for i in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in final}


ODD = [
    (None, None, None, None, None), (None, "no id here", "en", "s", 3), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "twice", "en", "s", 5), (3, "twice", "en", "s", 5),
    (4, "w " * 60_000, "en", "s", 120_000), (5, "same words in both texts and no more", "en", "s", 1), (6, "Same words in both texts and no more", "de", "t", 1),
]


def test_stages_on_odd_rows_and_none(spark, tmp_path):
    """Nulls everywhere, repeats, ties, a very long text, columns that clash; then an empty table."""
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item of the benchmark that no text holds"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 0, "clash", 0) for r in ODD], schema + ", did long, text_score string, node int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        assert docs.columns == corpus_pipeline.COLUMNS
    kept = docs.collect()
    # One of the texts without words, of the repeated row, and of the two alike.
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept) == [("1", ""), ("3", "twice"), ("4", ""), ("5", "same "), ("None", "no id")]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(packed) == 5
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
