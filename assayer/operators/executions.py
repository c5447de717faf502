"""Schedule executions: summaries over their check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.severity import from_rank, rank
from assayer.operators.skew import top_k

COUNTED = ("passed", "failed", "warning", "error", "skipped")


def execution_summary(requests: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("execution_id",)) -> DataFrame:
    """Requested checks and results per status, and the execution status.

    Every requested check counts toward the total; a request without a result of its check counts as
    an error, however many results a retry left for another check. Requests and results meet in
    one aggregation over their union rather than in a join, first by check, then by execution,
    so a large execution is combined before the shuffle.
    """
    columns = [F.col(k) for k in keys]
    severity = F.col("severity") if "severity" in results.columns else F.lit(None).cast("string")
    check = F.col("check_id")
    asked = requests.select(*columns, check, F.lit(1).alias("asked"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("rank"))
    failed_rank = F.when(F.col("status") == "failed", rank(severity))
    got = results.select(*columns, check, F.lit(0).alias("asked"), F.col("status"), failed_rank.alias("rank"))
    by_check = (
        asked.union(got)
        .groupBy(*keys, "check_id")
        .agg(
            F.sum("asked").alias("asked"),
            F.count_if(F.col("asked") == 0).alias("got"),
            *[F.count_if(F.col("status") == s).alias(s) for s in COUNTED],
            F.max("rank").alias("rank"),
        )
    )
    lost = F.greatest(F.col("asked") - F.col("got"), F.lit(0).cast("bigint"))
    tally = by_check.groupBy(*keys).agg(
        F.sum("asked").alias("total_checks"),
        F.sum(lost).alias("_lost"),
        *[F.sum(s).alias(f"{s}_checks") for s in COUNTED],
        F.max("rank").alias("_rank"),
    )
    return (
        tally.withColumn("error_checks", F.col("error_checks") + F.col("_lost"))
        .withColumn("max_failed_severity", from_rank(F.col("_rank")))
        .withColumn("status", execution_status(F.col("error_checks")))
        .drop("_lost", "_rank")
    )


def execution_status(error_checks: Column, list_error: Column | None = None) -> Column:
    """``partial`` after any error, else ``completed``; ``failed`` when the checks could not be listed."""
    status = F.when(error_checks > 0, F.lit("partial")).otherwise(F.lit("completed"))
    return status if list_error is None else F.when(list_error.isNotNull(), F.lit("failed")).otherwise(status)


def requested_checks(executions: DataFrame, schedules: DataFrame, checks: DataFrame) -> DataFrame:
    """(execution, check) pairs: all checks of the schedule's datasource, else its listed ones.

    Listed checks keep their repeats and need not exist; inactive checks are included and
    show up as skipped.
    """
    named = executions.join(schedules, "schedule_id")
    listed = named.where(F.coalesce(F.col("datasource_id"), F.lit("")) == "").select(
        "execution_id", "schedule_id", F.explode("check_ids").alias("check_id")
    )
    mine = checks.select(F.col("check_id"), F.col("datasource_id"), F.col("tenant_id").alias("_owner"))
    by_source = (
        named.where(F.coalesce(F.col("datasource_id"), F.lit("")) != "")
        .join(mine, "datasource_id")
        .where((F.coalesce(F.col("tenant_id"), F.lit("")) == "") | (F.col("tenant_id") == F.col("_owner")))
        .select("execution_id", "schedule_id", "check_id")
    )
    return listed.union(by_source)


def execution_history(executions: DataFrame, k: int, tie: str = "execution_id") -> DataFrame:
    """The last k executions of every schedule."""
    return top_k(executions, ["schedule_id"], [F.col("started_at").desc(), F.col(tie).desc()], k)
