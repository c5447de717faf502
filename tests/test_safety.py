"""Cases where a wrong answer would be a quiet one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import typed_literal
from assayer.operators import executions, governance, lineage
from assayer.operators.skew import salted_join, top_k
from assayer.operators.volume import by_bucket
from assayer.plans.catalog import Catalog
from assayer.plans.suite import execute
from assayer.specs import CheckParameters, CheckSpec, SpecError, ViewDefinition, ViewSpec
from tests.conftest import rows

RESULT = "tenant_id string, check_id string, table_name string, check_type string, actual_value double, status string, executed_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def gate(spark, results):
    policies = spark.createDataFrame([("t", True, 0.9, 0.9, True)], "tenant_id string, active boolean, completeness_threshold double, accuracy_threshold double, consistency_checks boolean")
    return {r.dataset: r.allowed for r in governance.quality_gate(spark.createDataFrame(results, RESULT), policies).collect()}


def test_an_error_is_not_a_pass(spark):
    later = T0 + dt.timedelta(hours=1)
    got = gate(spark, [
        ("t", "a", "lost", "null_check", None, "error", T0),
        ("t", "b", "mended", "null_check", None, "error", T0), ("t", "b", "mended", "null_check", 1.0, "passed", later),
        ("t", "c", "broken", "null_check", 0.0, "passed", T0), ("t", "c", "broken", "null_check", None, "error", later),
        ("t", "d", "old", "regex", 10.0, "failed", T0), ("t", "d", "old", "regex", 99.0, "passed", later),
        ("t", "e", "other", "row_count", None, "error", T0),
        ("nobody", "f", "free", "null_check", 90.0, "failed", T0),
    ])
    assert got == {"lost": False, "mended": True, "broken": False, "old": True, "other": True, "free": True}


def test_a_bad_pattern_denies_and_never_allows(spark):
    requests = spark.createDataFrame([(1, "p", "s", "read", "r", {}), (2, "q", "s", "read", "r", {}), (3, "o", "s", "read", "r", {})], "request_id int, policy_id string, subject string, action string, resource string, context map<string,string>")
    policies = spark.createDataFrame([("p", True), ("q", True), ("o", True)], "policy_id string, active boolean")
    rule = lambda policy, effect, value: (policy, effect, [], [], "subject", "matches", value)
    rules = spark.createDataFrame([rule("p", "allow", "(["), rule("q", "deny", "(["), rule("q", "allow", ".*"), rule("o", "allow", "^s$")], "policy_id string, effect string, actions array<string>, resources array<string>, field string, operator string, value string")
    assert {r.request_id: r.allowed for r in governance.access_decisions(requests, policies, rules).collect()} == {1: False, 2: False, 3: True}


def test_a_retry_does_not_hide_a_lost_check(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b")], "execution_id int, check_id string")
    got = spark.createDataFrame([(1, "a", "passed"), (1, "a", "passed")], "execution_id int, check_id string, status string")
    row = executions.execution_summary(asked, got).first()
    assert (row.total_checks, row.error_checks, row.status) == (2, 1, "partial")


def test_literals_are_not_rounded(spark):
    prices = spark.sql("SELECT CAST('1.01' AS DECIMAL(10,2)) AS p, DATE '2024-01-02' AS d, TIMESTAMP_NTZ '2024-01-02 10:00:00' AS t")
    test = lambda col, value, kind: prices.select((F.col(col) == typed_literal(value, kind)).alias("x")).first().x
    assert not test("p", "1.005", T.DecimalType(10, 2)) and test("p", "1.010", T.DecimalType(10, 2)) and test("p", 1.01, T.DecimalType(10, 2))
    assert not test("d", "2024-01-02 08:00:00", T.DateType()) and test("d", "2024-01-02", T.DateType())
    assert not test("d", dt.datetime(2024, 1, 2, 8), T.DateType())
    assert test("t", "2024-01-02T12:00:00+02:00", T.TimestampNTZType())
    with pytest.raises(SpecError):
        typed_literal("1e999", T.DecimalType(10, 2))


def test_names_in_any_case_and_views_of_the_user(spark):
    spark.range(3).createOrReplaceTempView("lines")
    catalog = Catalog(spark, {"Lines": spark.range(5), "gone": lambda: spark.read.parquet("/nowhere/at/all")})
    assert catalog.sql("SELECT COUNT(*) AS n FROM LINES").first().n == 5
    assert spark.table("lines").count() == 3
    spark.range(2).createOrReplaceTempView("gone")
    with pytest.raises(Exception):  # noqa: B017
        catalog.sql("SELECT * FROM gone").collect()
    assert spark.table("gone").count() == 2
    spark.range(1).createOrReplaceTempView("_view")
    spec = CheckSpec("c", "custom_sql", view_id="v", parameters=CheckParameters(custom_sql="SELECT COUNT(*) FROM _view", expected_value="5"))
    views = [ViewSpec("v", ViewDefinition(sql="SELECT * FROM lines"))]
    assert rows(execute([spec], Catalog(spark, {"lines": spark.range(5)}, views), lineage.run_dir(spark, "t"), "1"), "status") == [("passed",)]
    assert spark.table("_view").count() == 1
    for name in ("lines", "gone", "_view"):
        spark.catalog.dropTempView(name)


def test_nodes_of_different_pairs_differ(spark):
    events = spark.createDataFrame([("j", "n", [("s3://b/a", "c", "{}")], [("s3://b", "a/c", "{}")])], "job_namespace string, job_name string, inputs array<struct<namespace:string,name:string,facets:string>>, outputs array<struct<namespace:string,name:string,facets:string>>")
    row = lineage.dataset_edges(events).first()
    assert row.source != row.target


def test_tables_with_maps_can_be_salted_and_ranked(spark):
    table = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", F.create_map(F.lit("a"), F.col("id")).alias("m"))
    assert top_k(table, ["k"], [F.col("id")], 1200).count() == 2400
    assert salted_join(table, spark.createDataFrame([(0, "x")], "k2 int, w string"), [("k", "k2")], "inner", 0.1, 4).count() == 1500


def test_days_without_rows_are_buckets(spark):
    days = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 1, 4)] + [(None,)], "ts timestamp")
    got = [(r.bucket and r.bucket.day, r.row_count) for r in by_bucket(days, "ts", "day", 1, 0.0).orderBy("bucket").collect()]
    assert got == [(None, 1), (1, 2), (2, 0), (3, 0), (4, 1)]
    spec = CheckSpec("v", "volume", "t", parameters=CheckParameters(timestamp_column="ts", grain="week", expected_volume=3))
    row = execute([spec], Catalog(spark, {"t": days}), lineage.run_dir(spark, "t"), "1").first()
    assert row.status == "failed" and row.details["bucket_count"] == "2"


def test_a_bad_output_path_is_not_a_broken_check(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception):  # noqa: B017
        execute([CheckSpec("r", "row_count", "t")], Catalog(spark, {"t": spark.range(1)}), str(tmp_path / "file" / "out"), "1")
