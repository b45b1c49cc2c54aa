"""Append logs: one JSON object per line, read tolerantly, written append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import schemas


def parse_log_lines(lines: DataFrame, schema=schemas.UPLOAD_LOG, key: str = "url") -> DataFrame:
    """Rows of well-formed lines that carry a key; works on streams as well."""
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json(F.trim("value"), schema, {"mode": "PERMISSIVE"}).alias("r")
    )
    return parsed.select("r.*").filter(F.length(key) > 0)


def read_jsonl_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return parse_log_lines(reader.text(path))


def append_log(df: DataFrame, path: str) -> None:
    """Append one JSON line per row; null fields stay out of the line."""
    df.write.mode("append").json(path)
