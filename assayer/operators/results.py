"""Result history: last results, last status, and small analytics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.expressions import count_rows
from assayer.operators.skew import top_k


def scoped(df: DataFrame, tenant_id: str = "", datasource_id: str = "") -> DataFrame:
    """Rows of one tenant and/or datasource; an empty word means all. Partition folders prune."""
    if tenant_id:
        df = df.where(F.col("tenant_id") == tenant_id)
    if datasource_id:
        df = df.where(F.col("datasource_id") == datasource_id)
    return df


def history(results: DataFrame, k: int, tie: str | None = None) -> DataFrame:
    """The last k results of every check. ``tie`` orders results of the same instant."""
    return top_k(results, ["check_id"], _latest_first("executed_at", tie), k)


def last_status(results: DataFrame, tie: str | None = None) -> DataFrame:
    """Last run time and status per check."""
    order = F.col("executed_at") if tie is None else F.struct("executed_at", tie)
    return results.groupBy("check_id").agg(
        F.max("executed_at").alias("last_run_at"), F.max_by("status", order).alias("last_status")
    )


def check_state(checks: DataFrame, results: DataFrame, tie: str | None = None) -> DataFrame:
    """Checks with their last run; one that never ran is ``pending``."""
    state = last_status(results, tie)
    return checks.join(state, "check_id", "left").withColumn(
        "last_status", F.coalesce("last_status", F.lit("pending"))
    )


def failed_per_tenant(state: DataFrame) -> DataFrame:
    """Checks per tenant whose last status is ``failed``."""
    return state.where(F.col("last_status") == "failed").groupBy("tenant_id").agg(count_rows().alias("failed_checks"))


def recent_results(checks: DataFrame, results: DataFrame, k: int = 10, tie: str | None = None) -> DataFrame:
    """The last k results of every active check."""
    active = checks.where("active").select("check_id")
    return history(results.join(active, "check_id", "left_semi"), k, tie)


def _latest_first(column: str, tie: str | None) -> list[Column]:
    return [F.col(column).desc(), *([F.col(tie).desc()] if tie else [])]
