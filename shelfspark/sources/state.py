"""Publisher state: a JSON object with defaults, kept as tables keyed by url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import schemas

TABLES = ("scalars", "queue", "uploaded", "skipped", "errors")


def _default(dtype: T.DataType):
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.ArrayType):
        return F.array().cast(dtype)
    if isinstance(dtype, T.MapType):
        return F.create_map().cast(dtype)
    return F.lit(0)


def decode_state(df: DataFrame, payload: str = "value") -> DataFrame:
    """State rows; unknown fields are ignored, missing ones take their default."""
    row = df.select(F.from_json(payload, schemas.SCHEDULER_STATE).alias("s"))
    return row.select(*[
        F.coalesce(F.col(f"s.{f.name}"), _default(f.dataType)).alias(f.name)
        for f in schemas.SCHEDULER_STATE.fields
    ])


def state_tables(state: DataFrame) -> dict[str, DataFrame]:
    """The state as tables: scalars, queue(url, pos), uploaded, skipped, errors."""
    lists = ("branch_products", "uploaded_urls", "skipped_urls", "upload_error_by_url")
    return {
        "scalars": state.drop(*lists),
        "queue": state.select(F.posexplode("branch_products").alias("pos", "url")),
        "uploaded": state.select(F.explode("uploaded_urls").alias("url")),
        "skipped": state.select(F.explode("skipped_urls").alias("url")),
        "errors": state.select(F.explode("upload_error_by_url").alias("url", "error")),
    }


def import_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of one JSON state file."""
    return state_tables(decode_state(spark.read.text(path, wholetext=True)))


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    for name in TABLES:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
