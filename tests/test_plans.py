"""Physical plans: what would hurt at scale must not appear."""

import re

import pytest

from assayer.operators.skew import hot_keys, salted_join, top_k
from tests.conftest import DATA, plan_of, rows
from pyspark.sql import functions as F

from workload import QUERIES
from workload.base import catalog as tables
from workload.base import spec
from assayer.plans.suite import suite


def scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet .*{table}\.parquet", plan))


def test_fused_suite_scans_a_table_once(spark):
    checks = [
        spec("a", "row_count", "lineitem"), spec("b", "null_check", "lineitem", "l_tax"), spec("c", "min_value", "lineitem", "l_quantity"),
        spec("d", "regex", "lineitem", "l_returnflag", pattern="A"), spec("e", "range", "lineitem", "l_discount", expected_max=1.0),
        spec("f", "set_membership", "lineitem", "l_linestatus", allowed_values=["F"]), spec("g", "volume", "lineitem"),
    ]
    plan = plan_of(suite(checks, tables(spark, DATA)))
    assert scans(plan, "lineitem") == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "l_orderkey" not in schema and "l_partkey" not in schema


def test_distinct_checks_do_not_expand(spark):
    checks = [spec("a", "uniqueness", "orders", "o_orderkey"), spec("b", "uniqueness", "orders", "o_custkey")]
    plan = plan_of(suite(checks, tables(spark, DATA)))
    assert "Expand" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("threshold", ["-1", "1k", "100k", "10m", "10g"])
def test_referential_check_is_one_aggregation_whatever_the_sizes(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plan = plan_of(QUERIES["check_referential_fan_out"](spark, DATA))
        row = QUERIES["check_referential_fan_out"](spark, DATA).first()
        child = QUERIES["check_referential_child_mode"](spark, DATA).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert (row.total_count, row.matched_count) == (60257, 60000)
    assert (child.total_count, child.matched_count) == (15000, 14743)


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["view_filter_eq"](spark, DATA))
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]
    dated = plan_of(QUERIES["view_filter_gt_time"](spark, DATA))
    assert "GreaterThan(o_orderdate" in dated
    kept = plan_of(QUERIES["policy_retention"](spark, DATA))
    assert "GreaterThanOrEqual(l_shipdate" in kept


def test_history_keeps_only_k_rows_per_group_before_the_shuffle(spark):
    plan = plan_of(QUERIES["result_history"](spark, DATA))
    assert plan.index("Partial") > plan.index("Exchange hashpartitioning")


JVM_ONLY = [n for n in QUERIES if not n.startswith(("workflow_replay", "stream_", "lineage_downstream", "lineage_upstream", "source_", "sink_", "file_partitions"))]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    assert "Python" not in plan and "InPandas" not in plan
    if name != "view_join_cross":
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_keys_are_bounded(spark):
    table = spark.range(1000).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"))
    assert rows(hot_keys(table, ["k"], 0.1)) == [(1,)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50).alias("k"), F.lit("copy").alias("v"))
    right = spark.range(60).select((F.col("id") % 40).alias("k2"), F.col("id").alias("w"))
    got = salted_join(left, right, [("k", "k2")], how, 0.2, 8)
    assert rows(got.na.fill(-1)) == rows(left.join(right, F.col("k") == F.col("k2"), how).na.fill(-1))


def test_salt_splits_copies_over_partitions(spark):
    copies = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("k"))
    joined = salted_join(copies, spark.createDataFrame([(1, "x")], "k2 int, w string"), [("k", "k2")], "inner", 0.1, 16)
    assert joined.count() == 4000


def test_top_k_beyond_the_map_side_limit(spark):
    table = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = top_k(table, ["g"], [F.col("id").desc()], 1500)
    assert {tuple(r) for r in got.groupBy("g").agg(F.count("*"), F.min("id")).collect()} == {(0, 1500, 2000), (1, 1500, 2001)}
