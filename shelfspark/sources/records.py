"""JSON record files and polymorphic URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.core import coalesce_fields, let, strip_ws
from shelfspark.operators.queues import dedupe_first
from shelfspark.sources.arrays import read_elements

_STRICT = {"allowSingleQuotes": "false"}


def _elements(text: Column) -> Column:
    """Elements of a JSON array as text (objects stay JSON), null when it is none."""
    return F.when(
        text.startswith("[") & text.endswith("]"),
        F.from_json(text, "array<string>", _STRICT),
    )


def decode_records(df: DataFrame, payload: str, schema: T.StructType, key: str) -> DataFrame:
    """Objects of JSON-array payloads; other payloads, non-objects and rows with a
    blank key are dropped. ``ord`` is the position within the payload."""
    body = strip_ws(F.regexp_replace(payload, "^﻿", ""))
    rows = df.select(
        *[c for c in df.columns if c != payload],
        F.posexplode(let(body, _elements)).alias("ord", "_e"),
    ).filter(F.col("_e").startswith("{"))
    rows = rows.withColumn("_r", F.from_json("_e", schema, _STRICT))
    keep = [c for c in rows.columns if c not in ("_e", "_r", "ord")]
    out = rows.select(*keep, F.col("ord").cast("bigint").alias("ord"), "_r.*")
    return out.filter(F.length(F.trim(F.col(key).cast("string"))) > 0)


def read_records(
    spark: SparkSession, path: str, schema: T.StructType, key: str
) -> DataFrame:
    """Rows of JSON-array files of any size: a file is split between tasks.

    Files that are no array, elements that are no object and rows with a blank key are dropped.
    """
    elements, _, _ = read_elements(spark, path)
    rows = elements.where("shape = 'array'").select("file", "ord", _value("element").alias("_e")).filter(F.col("_e").startswith("{"))
    rows = rows.withColumn("_r", F.from_json("_e", schema, _STRICT))
    return rows.select("file", "ord", "_r.*").filter(F.length(F.trim(F.col(key).cast("string"))) > 0)


def _value(element: str) -> Column:
    """An element's text: that of a string without quotes, an object as JSON."""
    return F.get(F.from_json(F.concat(F.lit("["), F.col(element), F.lit("]")), "array<string>", _STRICT), 0)


def decode_url_lists(df: DataFrame, payload: str) -> DataFrame:
    """One row per URL of payloads in any of five shapes, with its position.

    Arrays of strings; arrays of objects (product_url, then url);
    ``{"results": [..]}`` (url, then product_url); ``{"urls": [..]}``; any other
    text has one URL per line.
    """

    def of_objects(items: Column, first: str, second: str) -> Column:
        pick = lambda e: coalesce_fields(
            F.get_json_object(e, f"$.{first}"), F.get_json_object(e, f"$.{second}")
        )
        return F.transform(
            items, lambda e: F.when(e.startswith("{"), pick(e)).otherwise(F.lit(""))
        )

    def of_strings(items: Column) -> Column:
        return F.transform(items, lambda e: F.trim(F.coalesce(e, F.lit(""))))

    def of_list(items: Column) -> Column:
        pick = lambda e: coalesce_fields(
            F.get_json_object(e, "$.product_url"), F.get_json_object(e, "$.url")
        )
        return F.transform(
            items,
            lambda e: F.when(e.startswith("{"), pick(e)).otherwise(
                F.trim(F.coalesce(e, F.lit("")))
            ),
        )

    def decode(t: Column) -> Column:
        is_object = (
            t.startswith("{") & t.endswith("}") & F.get_json_object(t, "$").isNotNull()
        )
        part = lambda name: _elements(F.get_json_object(t, f"$.{name}"))
        from_object = F.coalesce(
            of_objects(part("results"), "url", "product_url"),
            of_strings(part("urls")),
            F.array().cast("array<string>"),
        )
        lines = F.transform(F.split(t, r"\r\n|[\n\r]"), strip_ws)
        return F.when(is_object, from_object).otherwise(F.coalesce(of_list(_elements(t)), lines))

    body = strip_ws(F.regexp_replace(payload, "^﻿", ""))
    out = df.select(
        *[c for c in df.columns if c != payload],
        F.posexplode(let(body, decode)).alias("ord", "url"),
    )
    return out.filter(F.col("url") != "").withColumn("ord", F.col("ord").cast("bigint"))


def _first_of(element: Column, first: str, second: str) -> Column:
    return coalesce_fields(F.get_json_object(element, f"$.{first}"), F.get_json_object(element, f"$.{second}"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """Unique URLs of list files in any of the five shapes, first seen first (files by name).

    Arrays (plain, or the only value of "results" or "urls") and files of lines are split
    between tasks; an object with more keys is one value.
    """
    elements, objects, lines = read_elements(spark, path)
    e = F.col("_e")
    listed = F.when(e.startswith("{"), _first_of(e, "product_url", "url")).otherwise(F.trim(F.coalesce(e, F.lit(""))))
    urls = (
        F.when(F.col("shape") == "array", listed)
        .when(F.col("shape") == "urls", F.trim(F.coalesce(e, F.lit(""))))
        .when(e.startswith("{"), _first_of(e, "url", "product_url"))
    )
    found = elements.withColumn("_e", _value("element")).select("file", F.lit(0).cast("long").alias("block"), "ord", urls.alias("url"))
    if objects:
        whole = spark.read.text(objects, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        found = found.union(decode_url_lists(whole, "value").select("file", F.lit(0).cast("long"), "ord", "url"))
    if lines:
        found = found.union(_lines(spark, lines))
    return dedupe_first(found.where("url <> ''"), "url", ["file", "block", "ord"], out="url").drop("block")


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, ord, url): lines in order, by split and row in it."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
        strip_ws(F.regexp_replace("value", "^\ufeff", "")).alias("url"),
    )


def read_url_lines(spark: SparkSession, path: str) -> DataFrame:
    """Unique URLs of plain line files of any size: files are split, and the order
    is (file, split start, row in split)."""
    return dedupe_first(_lines(spark, path), "url", ["file", "block", "ord"], out="url").drop("block")
