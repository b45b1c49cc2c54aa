"""Reports over result tables: one aggregation each, partial before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.core import to_float


def summarize(results: DataFrame) -> DataFrame:
    """One row of counts; a blocked page counts as without media and as an error."""
    n_items = lambda c: F.coalesce(F.size(c), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_video").alias("with_video"),
        F.count_if(~F.coalesce("has_video", F.lit(False))).alias("without_video"),
        F.count_if("blocked").alias("blocked"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("page_errors"),
        F.count_if(n_items("downloaded_videos") > 0).alias("downloaded_products"),
        zero(F.sum(n_items("downloaded_videos"))).alias("downloaded_videos"),
        zero(F.sum(n_items("download_errors"))).alias("download_errors"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def gauge_stats(samples: DataFrame, line: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """Gauge lines ``utilisation,total,used``: count, mean, peak, percent used.

    Lines with fewer than three fields or a non-number are dropped.
    """
    fields = F.transform(F.split(line, ","), lambda x: F.trim(x))
    parsed = samples.withColumn("_f", fields).select(
        *group,
        *[
            to_float(F.try_element_at("_f", F.lit(i + 1))).alias(n)
            for i, n in enumerate(("util", "total", "used"))
        ],
    )
    parsed = parsed.filter(
        F.col("util").isNotNull() & F.col("total").isNotNull() & F.col("used").isNotNull()
    )
    total, used = F.sum("total"), F.sum("used")
    return parsed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("gauges"),
        F.avg("util").alias("util_avg"),
        F.max("util").alias("util_peak"),
        F.when(total > 0, used / total * 100.0).otherwise(F.lit(0.0)).alias("mem_percent"),
        (total / 1024.0).alias("total_gb"),
        (used / 1024.0).alias("used_gb"),
    )
