"""Report sinks: detail rows plus one summary row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.operators.aggregates import summarize


def write_report(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write ``path/results`` and, counted from what was written, ``path/summary``."""
    results.write.mode("overwrite").format(fmt).save(f"{path}/results")
    spark = results.sparkSession
    written = spark.read.format(fmt).schema(results.schema).load(f"{path}/results")
    summarize(written).write.mode("overwrite").format(fmt).save(f"{path}/summary")


def read_report(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    return spark.read.format(fmt).load(f"{path}/results"), spark.read.format(fmt).load(
        f"{path}/summary"
    )


def write_urls(results: DataFrame, path: str, column: str = "url") -> None:
    """URL-only projection, one per line."""
    results.select(column).write.mode("overwrite").text(path)
