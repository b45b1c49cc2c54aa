"""Shared pieces of the query registry: table access and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as it is, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL fragments of the oracle (RE2 syntax) ------------------------------
SPLIT = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"
WS = r"'[\s\p{Z}\x{85}\x0b]+'"


def part(url: str, n: int) -> str:
    return f"regexp_extract({url}, {SPLIT}, {n})"


def path(url: str) -> str:
    return f"regexp_replace({part(url, 3)}, ';[^/]*$', '')"


def collapse(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), {WS}, ' ', 'g'))"


def canonical(url: str, root_slash: bool = True) -> str:
    cut = f"regexp_replace({path(url)}, '(?s)/ref=.*$', '')"
    p = f"CASE WHEN {cut} = '/' THEN '/' ELSE regexp_replace({cut}, '/+$', '') END"
    if root_slash:
        p = f"CASE WHEN ({p}) = '' THEN '/' ELSE ({p}) END"
    return (
        f"('https://' || lower({part(url, 2)}) || CASE WHEN ({p}) = '' OR starts_with(({p}), '/')"
        f" THEN ({p}) ELSE '/' || ({p}) END)"
    )


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
