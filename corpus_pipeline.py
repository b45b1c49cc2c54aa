"""A training corpus from documents: reject toxic, drop near copies, cut repeats, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``run`` writes each result and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import common, decontamination, near_copies, packing, substring_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The stages have no SQL: classifier, fingerprints and tokenizer are beyond it.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic.

    Null and empty texts are scored as empty ones; repeated rows stay or go together; ties of
    similarity go to the smaller example id; an empty table gives none. Columns other than
    those of documents are dropped here, so they cannot clash later.
    """
    return toxicity.keep_clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group alike in 0.8 of their 5-word shingles.

    All texts that are null or without words are one group; of repeated rows one stays; rows
    without doc_id come last in a group; an empty table gives none.
    """
    return near_copies.keep_one(docs.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words that occur elsewhere.

    Null and empty texts stay as they are; a text cut to nothing stays as an empty one;
    repeated rows count as each other's copies; n_chars follows the text where it was cut.
    """
    cut = substring_dedup.remove_repeats(docs.select(COLUMNS), k=35, more=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return cut.withColumn("n_chars", n_chars).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark drops none.
    """
    return decontamination.keep_uncontaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 2048 tokens.

    Null and empty texts are one piece of one id; repeated rows are packed each; lengths that
    tie are taken in the order of their hash; an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
