"""Row volume per time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import count_rows
from assayer.specs import SpecError

GRAINS = ("hour", "day", "week", "month", "quarter", "year")


def by_bucket(df: DataFrame, column: str, grain: str, expected: int, tolerance: float) -> DataFrame:
    """Rows per bucket; buckets further than ``tolerance`` percent from ``expected`` fail.

    Every bucket between the first and the last is there, also without rows: those are what the
    check is for. Rows without a time are one bucket, NULL. A table without rows has no bucket.
    """
    if grain not in GRAINS:
        raise SpecError(f"unknown grain {grain!r}")
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType) and grain == "hour":
        raise SpecError("a date has no hours")
    bucket = F.date_trunc(grain, F.col(column)).cast(kind)
    counts = df.groupBy(bucket.alias("bucket")).agg(count_rows().alias("row_count"))
    step = F.expr({"quarter": "INTERVAL 3 MONTH", "week": "INTERVAL 7 DAY"}.get(grain, f"INTERVAL 1 {grain.upper()}"))
    ends = counts.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).where(F.col("low").isNotNull())
    none = F.lit(0).cast("bigint").alias("row_count")
    spine = ends.select(F.explode(F.sequence("low", "high", step)).alias("bucket"), none)
    counts = counts.union(spine).groupBy("bucket").agg(F.sum("row_count").alias("row_count"))
    off = F.abs(F.col("row_count").cast("double") - F.lit(float(expected)))
    return counts.select(
        "bucket",
        "row_count",
        (off / F.lit(float(expected)) * 100.0).alias("deviation_percentage"),
        F.when(off > F.lit(expected * tolerance / 100.0), F.lit("failed")).otherwise(F.lit("passed")).alias("status"),
    )
