"""Result, execution, alert and lineage tables, appended as partitioned Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Write so that repeating the same write leaves one copy of the touched partitions."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


#: What Spark escapes in the values of partition folders.
_ESCAPED = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def run_folder(path: str, run_id: str) -> str:
    return f"{path}/run_id=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", run_id)


def write_results(results: DataFrame, path: str, run_id: str, started: float) -> None:
    """Write the rows of one run, without skipped checks, in place of an earlier try of the run.

    Results are a handful of rows, so they are written as one file per run, which ``history.compact`` folds
    with those of other runs. The folder is complete once it has its ``_SUCCESS``.
    """
    table = results.where("stored").drop("stored").withColumn("started_at", F.lit(started).cast("timestamp"))
    table.coalesce(1).write.mode("overwrite").parquet(run_folder(path, run_id))


def write_dated(df: DataFrame, path: str, time_column: str, tenant_column: str | None = None) -> None:
    """Append events or history under (tenant, date) folders, so that both prune."""
    dated = df.withColumn("event_date", F.to_date(F.col(time_column)))
    append_table(dated, path, [c for c in (tenant_column, "event_date") if c])
