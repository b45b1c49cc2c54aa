"""Stored tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark import schemas


def read_pages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Stored page bodies (page_id, url, html)."""
    if streaming:
        return spark.readStream.schema(schemas.PAGES).parquet(path)
    return spark.read.schema(schemas.PAGES).parquet(path)
