"""WARC records and a Merkle fixity audit of two replicas.

A record is hashed where it is read. Records stand in archives of 4096 slots by page_id,
so a lost or added record changes its own slot only; a slot knows its place among the
archive's bytes. Sixteen neighbouring slots make a node, sixteen nodes the next, and three
levels the archive's root: each node is the hash of its children in order and covers a
range of offsets. The audit joins the roots of both replicas and goes down only below
those that differ, to the slots.

A slot's hash is a sum over its records, so repeated page_ids are added up map-side and
never gathered; every other group has at most sixteen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm import common as C

SLOTS = 4096
FAN = 16
LEVELS = 3
#: Archives that rows without page_id are dealt into.
LOOSE = 1024
_END = "\r\n\r\n"


def record(pages: DataFrame) -> Column:
    """One WARC/1.1 resource record as text, without the two line ends that close it."""
    body = F.coalesce(F.col("html"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col("url"), F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body,
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """WARC files under ``path``, one per partition; null url and html are written as empty."""
    pages.select(record(pages).alias("value")).write.option("lineSep", _END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html, intact of the records that ``write_warc`` wrote.

    Files are split between tasks at record heads. A body that itself holds a record head
    is cut there; such rows and other damaged ones have ``intact`` false, as their length
    disagrees with their Content-Length.
    """
    head = "WARC/1.1\r\n"
    rows = spark.read.option("lineSep", head).text(path).where(F.length("value") > 0)
    cut = F.instr("value", _END)
    rows = rows.where(cut > 0).select(
        F.expr(f"substring(value, 1, instr(value, '{_END}') - 1)").alias("head"),
        F.expr(f"substring(value, instr(value, '{_END}') + 4)").alias("body"),
    )
    closed = F.col("body").endswith(_END)
    body = F.when(closed, F.expr("substring(body, 1, length(body) - 4)")).otherwise(F.col("body"))
    size = F.regexp_extract("head", r"Content-Length: (\d+)", 1).cast("long")
    number = F.regexp_extract("head", r"WARC-Record-ID: <urn:page:(-?\d*)>", 1)
    return rows.select(
        F.when(number != "", number.cast("long")).alias("page_id"),
        F.regexp_extract("head", r"WARC-Target-URI: ([^\r\n]*)", 1).alias("url"),
        body.alias("html"), (closed & (F.octet_length(body) == size)).alias("intact"),
    )


def slots(pages: DataFrame) -> DataFrame:
    """archive, slot, records, length, offset, hash of every slot that holds a record."""
    text = record(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(text, 256).alias("digest"), (F.octet_length(text) + len(_END)).cast("long").alias("length"))
    loose = F.xxhash64("digest")
    archive = F.when(F.col("page_id").isNull(), F.pmod(loose, F.lit(LOOSE))).otherwise(F.shiftright("page_id", 12))
    slot = F.when(F.col("page_id").isNull(), F.pmod(F.shiftrightunsigned(loose, 12), F.lit(SLOTS))).otherwise(F.pmod("page_id", F.lit(SLOTS)))
    parts = [F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = rows.select(archive.alias("archive"), F.col("page_id").isNull().alias("loose"), slot.cast("int").alias("slot"), "length", *(p.alias(f"p{i}") for i, p in enumerate(parts)))
    held = sums.groupBy("archive", "loose", "slot").agg(
        F.count(F.lit(1)).alias("records"), F.sum("length").alias("length"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(4))
    )
    before = Window.partitionBy("archive", "loose").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return held.select(
        "archive", "loose", "slot", "records", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        F.sha2(F.concat_ws("|", "records", "length", *(f"p{i}" for i in range(4))), 256).alias("hash"),
    )


def _up(nodes: DataFrame) -> DataFrame:
    """The level above: hash of up to sixteen children in order, and their range of offsets."""
    children = F.sort_array(F.collect_list(F.struct("slot", "hash")))
    return nodes.groupBy("archive", "loose", F.shiftright("slot", 4).alias("slot")).agg(
        F.sha2(F.concat_ws("|", F.transform(children, lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["hash"]))), 256).alias("hash"),
        F.sum("records").alias("records"), F.min("offset").alias("offset"), F.sum("length").alias("length"),
    )


def tree(pages: DataFrame) -> list[DataFrame]:
    """Levels from the slots (0) to the roots of the archives (3)."""
    levels = [C.stage(slots(pages), "slots")]
    for _ in range(LEVELS):
        levels.append(_up(levels[-1]))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Slots that differ: archive, slot, page_id, kind, records, offset, length, replica_length.

    kind is ``changed``, ``missing`` (from the replica) or ``extra``. offset, length and
    records tell the place in the primary's archive (the replica's, for ``extra``). Rows
    without page_id are found by content: a changed one is both missing and extra, with
    page_id null. Null url and html count as empty; the order of rows does not matter;
    records repeated under one page_id are compared as a whole; other columns are
    ignored. Equal tables give no rows.
    """
    ours, theirs = tree(primary), tree(replica)
    key = ["archive", "loose", "slot"]
    below: DataFrame | None = None
    for a, b in zip(reversed(ours), reversed(theirs), strict=True):
        if below is not None:
            parent = F.shiftright("slot", 4).alias("parent")
            open_ = below.select("archive", "loose", F.col("slot").alias("parent"))
            a, b = (x.withColumn("parent", parent).join(open_, ["archive", "loose", "parent"], "left_semi") for x in (a, b))
        x = a.select(*key, *(F.col(c).alias(f"a_{c}") for c in ("hash", "records", "offset", "length")))
        y = b.select(*key, *(F.col(c).alias(f"b_{c}") for c in ("hash", "records", "offset", "length")))
        below = x.join(y, key, "full_outer").where(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
    kind = F.when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash").isNull(), "extra").otherwise("changed")
    return below.select(
        "archive", "slot", F.when(~F.col("loose"), F.col("archive") * SLOTS + F.col("slot")).alias("page_id"), kind.alias("kind"),
        *(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in ("records", "offset")),
        F.col("a_length").alias("length"), F.col("b_length").alias("replica_length"),
    )
