"""Share of every value of a column, next to the share that was expected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import column_type, count_rows, typed_literal


def shares(df: DataFrame, column: str, expected: dict[str, float] | None = None) -> DataFrame:
    """One row per value that occurs or is expected: rows, both shares and their distance.

    The total comes from a scalar subquery over the per-value counts, so no task ever sees
    all values at once.
    """
    data_type = column_type(df, column)
    counts = df.groupBy(F.col(column).alias("value")).agg(count_rows().alias("row_count"))
    total = counts.agg(F.sum("row_count").cast("double").alias("t"))
    none = F.lit(None).cast("double")
    known = counts.withColumn("expected_share", none)
    if expected:
        wanted = F.array(
            *[F.struct(typed_literal(v, data_type).cast(data_type).alias("value"), F.lit(float(s)).alias("s")) for v, s in expected.items()]
        )
        rows = df.sparkSession.range(1).select(F.explode(wanted).alias("e"))
        known = (
            known.union(rows.select("e.value", F.lit(0).cast("bigint"), "e.s"))
            .groupBy("value")
            .agg(F.sum("row_count").alias("row_count"), F.max("expected_share").alias("expected_share"))
        )
    share = F.col("row_count").cast("double") / total.scalar()
    return known.withColumn("actual_share", share).select(
        "value",
        "row_count",
        "actual_share",
        "expected_share",
        F.abs(F.col("actual_share") - F.coalesce("expected_share", F.lit(0.0))).alias("deviation"),
    )
