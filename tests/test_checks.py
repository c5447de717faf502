"""Verdicts on small tables: limits, empty input, NULLs, errors."""

import datetime as dt

import pytest

from assayer.operators import distribution, volume
from assayer.operators.checks import canonical_type, check_types, measure
from assayer.plans.catalog import Catalog
from assayer.plans.suite import RESULT_FIELDS, execute, select_checks, suite
from assayer.specs import CheckParameters, CheckSpec, ColumnInfo, SpecError, Threshold, ViewDefinition, ViewSpec
from tests.conftest import rows


def spec(type, table="people", column=None, threshold=None, **params):
    extra = {k: params.pop(k) for k in ("warn_threshold", "view_id", "active", "severity") if k in params}
    return CheckSpec("c", type, table, column, parameters=CheckParameters(**params), threshold=threshold or Threshold(), **extra)


def one(catalog, check):
    return suite([check], catalog).first()


def status(catalog, check):
    return one(catalog, check).status


def test_all_declared_types_are_known():
    assert check_types() == sorted(
        "row_count null_check uniqueness freshness custom_sql min_value max_value mean_value sum_value std_dev regex format range "
        "set_membership referential_integrity volume distribution schema_match column_count column_type".split()
    )


@pytest.mark.parametrize(
    "params, expected",
    [({}, "passed"), ({"min_rows": 4}, "passed"), ({"min_rows": 5}, "failed"), ({"max_rows": 3}, "failed"), ({"max_rows": 4}, "passed"),
     ({"min_rows": 0, "max_rows": 0}, "passed"), ({"max_rows": 0, "strict_zero": True}, "failed")],
)
def test_row_count(catalog, params, expected):
    assert status(catalog, spec("row_count", **params)) == expected


def test_row_count_reports_the_broken_limit(catalog):
    assert one(catalog, spec("row_count", min_rows=5, max_rows=3)).expected_value == 5
    assert one(catalog, spec("row_count", min_rows=1, max_rows=3)).expected_value == 3


@pytest.mark.parametrize(
    "params, expected",
    [({}, "passed"), ({"max_null_percentage": 50.0}, "passed"), ({"max_null_percentage": 49.9}, "failed"), ({"max_null_count": 2}, "passed"),
     ({"max_null_count": 1}, "failed"), ({"max_null_percentage": 0.0}, "passed"), ({"max_null_percentage": 0.0, "strict_zero": True}, "failed")],
)
def test_null_check(catalog, params, expected):
    assert status(catalog, spec("null_check", column="name", **params)) == expected


def test_uniqueness_ignores_null_keys(catalog):
    row = measure(spec("uniqueness", column="id"), catalog.resolve("people"), catalog.context()).first()
    assert (row.total_count, row.unique_count, row.null_key_count, row.duplicate_count, row.status) == (4, 2, 1, 2, "failed")
    assert status(catalog, spec("uniqueness", column="id", threshold=Threshold(value=50.0))) == "passed"
    assert status(catalog, spec("uniqueness", column="id", threshold=Threshold(value=50.0), allow_nulls=False)) == "failed"


def test_uniqueness_over_columns_excludes_partial_nulls(catalog):
    row = measure(spec("uniqueness", unique_columns=["id", "name"]), catalog.resolve("people"), catalog.context()).first()
    assert (row.total_count, row.unique_count) == (4, 2)


def test_freshness(spark):
    table = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (None,)], "ts timestamp_ntz")
    tables = Catalog(spark, {"t": table, "none": table.where("ts is null")})
    fresh = lambda t, h, **k: status(tables, spec("freshness", t, timestamp_column="ts", as_of="2024-01-01 06:00:00", max_age_hours=h, **k))
    assert fresh("t", 6.0) == "passed"
    assert fresh("t", 5.9) == "failed"
    assert fresh("t", 8.0, warn_threshold=5.0) == "warning"
    assert fresh("none", 6.0) == "error"
    assert status(tables, spec("freshness", "t")) == "error"


def test_freshness_of_zoned_timestamps_counts_instants(spark):
    zoned = spark.sql("SELECT TIMESTAMP '2024-01-01 02:00:00+02:00' AS ts")
    row = measure(spec("freshness", "z", timestamp_column="ts", as_of="2024-01-01 03:00:00"), zoned, None).first()
    assert row.age_hours == 3.0


@pytest.mark.parametrize(
    "type, params, expected",
    [("min_value", {"expected_min": 10.0}, "passed"), ("min_value", {"expected_min": 9.0}, "failed"),
     ("min_value", {"expected_min": 9.0, "tolerance": 1.0}, "passed"), ("max_value", {"expected_max": 50.0}, "failed"),
     ("max_value", {}, "passed"), ("mean_value", {"expected_mean": 23.0, "tolerance": 0.5}, "passed"), ("sum_value", {}, "passed"),
     ("std_dev", {}, "passed")],
)
def test_value_checks_are_two_sided(catalog, type, params, expected):
    assert status(catalog, spec(type, column="amount", **params)) == expected


def test_tolerance_falls_back_to_threshold(catalog):
    assert status(catalog, spec("min_value", column="amount", expected_min=9.0, threshold=Threshold(value=1.0))) == "passed"


@pytest.mark.parametrize(
    "operator, value, expected",
    [("eq", 70, "passed"), ("ne", 70, "failed"), ("lt", 70, "failed"), ("lte", 70, "passed"), ("gt", 70, "failed"), ("gte", 70, "passed")],
)
def test_threshold_operators_replace_the_verdict(catalog, operator, value, expected):
    assert status(catalog, spec("sum_value", column="amount", threshold=Threshold(operator=operator, value=value))) == expected


def test_threshold_between_and_percentage(catalog):
    between = Threshold(operator="between", min_value=3, max_value=5)
    assert status(catalog, spec("row_count", threshold=between, min_rows=100)) == "passed"
    share = Threshold(type="percentage", operator="lte", value=50)
    assert status(catalog, spec("null_check", column="name", threshold=share)) == "passed"
    assert status(catalog, spec("row_count", threshold=share)) == "error"
    assert status(catalog, spec("row_count", threshold=Threshold(operator="around"))) == "error"


def test_regex_is_unanchored_and_nulls_do_not_match(catalog):
    row = measure(spec("regex", column="name", pattern="n"), catalog.resolve("people"), catalog.context()).first()
    assert (row.match_count, row.non_match_count, row.match_percentage) == (1, 3, 25.0)
    assert status(catalog, spec("regex", column="name", pattern="(")) == "error"
    assert status(catalog, spec("regex", column="name")) == "error"


@pytest.mark.parametrize(
    "format, good, bad",
    [("email", "a.b@x.org", "a@x"), ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567"), ("ipv4", "10.0.0.255", "10.0.0.256"),
     ("url", "https://x.org/a?b", "ftp://x"), ("integer", "-12", "1.5"), ("decimal", "1.5", "1,5"), ("date", "2024-02-29", "2023-02-29"),
     ("datetime", "2024-01-01 10:00:00", "10:00")],
)
def test_formats(spark, format, good, bad):
    table = spark.createDataFrame([(good,), (bad,), (None,)], "v string")
    row = measure(spec("format", "t", "v", format=format), table, None).first()
    assert (row.total_count, row.match_count) == (3, 1)


def test_range_applies_both_bounds(catalog):
    row = measure(spec("range", column="amount", expected_max=20.0), catalog.resolve("people"), catalog.context()).first()
    assert (row.in_range_count, row.out_of_range_count) == (2, 2)
    negative = measure(spec("range", column="amount", expected_min=-5.0), catalog.resolve("people"), catalog.context()).first()
    assert negative.in_range_count == 0


def test_set_values_take_the_column_type(catalog):
    row = measure(spec("set_membership", column="amount", allowed_values=["10", "20.00"]), catalog.resolve("people"), catalog.context()).first()
    assert (row.valid_count, row.invalid_count) == (2, 2)
    assert status(catalog, spec("set_membership", column="amount", allowed_values=["ten"])) == "error"
    assert status(catalog, spec("set_membership", column="amount")) == "error"
    quoted = measure(spec("set_membership", column="name", allowed_values=["ann' OR '1'='1"]), catalog.resolve("people"), catalog.context())
    assert quoted.first().valid_count == 0


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_referential_counts_match_a_left_join(spark, people, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = spark.createDataFrame([(1,), (2,), (2,), (7,), (None,)], "k bigint")
    tables = Catalog(spark, {"people": people, "keys": keys})
    joined = people.join(keys, people.id == keys.k, "left")
    row = measure(spec("referential_integrity", column="id", reference_table="keys", reference_column="k"), people, tables.context()).first()
    assert (row.total_count, row.matched_count) == (joined.count(), joined.where("k is not null").count()) == (6, 5)
    child = measure(
        spec("referential_integrity", column="id", reference_table="keys", reference_column="k", count_mode="child"), people, tables.context()
    ).first()
    assert (child.total_count, child.matched_count, child.orphan_count) == (4, 3, 1)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_referential_errors(catalog):
    assert status(catalog, spec("referential_integrity", column="id")) == "error"
    wrong = spec("referential_integrity", column="id", reference_table="people", reference_column="name")
    assert "cannot compare" in one(catalog, wrong).error
    assert status(catalog, spec("referential_integrity", column="id", reference_table="nowhere", reference_column="id")) == "error"


def test_empty_table_verdicts(catalog):
    got = {
        c: status(catalog, spec(c, "nobody", "name", pattern="a", allowed_values=["a"], reference_table="people", reference_column="name"))
        for c in ("row_count", "null_check", "uniqueness", "regex", "set_membership", "referential_integrity")
    }
    assert got == {
        "row_count": "passed", "null_check": "passed", "uniqueness": "failed", "regex": "failed", "set_membership": "failed",
        "referential_integrity": "failed",
    }
    assert status(catalog, spec("range", "nobody", "amount", expected_max=1.0)) == "failed"
    assert status(catalog, spec("min_value", "nobody", "amount", expected_min=1.0)) == "error"
    assert status(catalog, spec("min_value", "nobody", "amount")) == "passed"


def test_schema_checks(catalog):
    expected = (ColumnInfo("id", "bigint"), ColumnInfo("name"), ColumnInfo("amount", "double"))
    assert status(catalog, spec("schema_match", expected_schema=expected)) == "passed"
    assert status(catalog, spec("schema_match", expected_schema=expected[:2])) == "passed"
    assert status(catalog, spec("schema_match", expected_schema=expected[:2], fail_on_extra=True)) == "failed"
    assert status(catalog, spec("schema_match")) == "passed"
    row = one(catalog, spec("schema_match", expected_schema=(ColumnInfo("id", "int"), ColumnInfo("ID"))))
    assert row.status == "failed" and row.details["missing_columns"] == "ID"
    assert status(catalog, spec("column_count", expected_columns=3)) == "passed"
    assert status(catalog, spec("column_count", expected_columns=4)) == "failed"
    assert status(catalog, spec("column_type", column="amount", expected_schema=(ColumnInfo("amount", "float8"),))) == "passed"
    assert status(catalog, spec("column_type", column="amount", expected_schema=(ColumnInfo("amount", "text"),))) == "failed"


def test_type_aliases():
    assert canonical_type("VARCHAR(20)") == "string"
    assert canonical_type("double  precision") == "double"
    assert canonical_type("numeric(10,2)") == "decimal(10,2)"


@pytest.mark.parametrize(
    "sql, expected, want",
    [("SELECT COUNT(*) FROM people", "4", "passed"), ("SELECT COUNT(*) FROM people", "4.0", "failed"), ("SELECT 'a'", "b", "failed"),
     ("SELECT id FROM people WHERE id > 9", "1", "failed"), ("SELECT * FROM people", None, "passed"), ("SELECT * FROM nobody", None, "failed"),
     ("SELECT * FROM missing_table", None, "error"), ("SELECT nothing FROM people", None, "error"), ("", None, "error")],
)
def test_custom_sql(catalog, sql, expected, want):
    assert status(catalog, spec("custom_sql", custom_sql=sql, expected_value=expected)) == want


def test_volume_and_distribution(catalog, people):
    assert status(catalog, spec("volume", expected_volume=5, volume_tolerance=20.0)) == "passed"
    assert status(catalog, spec("volume", expected_volume=6, volume_tolerance=20.0)) == "failed"
    expected = {"ann": 0.25, "bob": 0.25}
    row = measure(spec("distribution", column="name", expected_distribution=expected, tolerance=0.1), people, None).first()
    assert (row.max_deviation, row.status) == (0.5, "failed")  # NULL is an unexpected value
    shares = {r.value: (r.row_count, r.actual_share, r.expected_share) for r in distribution.shares(people, "name", {"ann": 0.5, "zoe": 0.5}).collect()}
    assert shares == {"ann": (1, 0.25, 0.5), "bob": (1, 0.25, None), None: (2, 0.5, None), "zoe": (0, 0.0, 0.5)}


def test_volume_by_bucket(spark):
    table = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (1, 2, 3)] + [(dt.datetime(2024, 1, 2),)], "ts timestamp_ntz")
    got = rows(volume.by_bucket(table, "ts", "day", 3, 10.0), "row_count", "status")
    assert got == [(1, "failed"), (3, "passed")]
    with pytest.raises(SpecError):
        volume.by_bucket(table, "ts", "fortnight", 3, 10.0)


def test_warning_lies_between_good_and_failed(catalog):
    half = lambda warn: spec("regex", column="name", pattern=".", threshold=Threshold(value=40.0), warn_threshold=warn)
    assert status(catalog, half(45.0)) == "passed"
    assert status(catalog, half(60.0)) == "warning"


def test_suite_keeps_going_past_bad_checks(catalog):
    specs = [
        CheckSpec("good", "row_count", "people"), CheckSpec("typo", "row_cuont", "people"), CheckSpec("lost", "null_check", "people", "nope"),
        CheckSpec("gone", "row_count", "nowhere"), CheckSpec("off", "row_count", "people", active=False),
    ]
    got = {r.check_id: (r.status, r.stored) for r in suite(specs, catalog).collect()}
    assert got == {"good": ("passed", True), "typo": ("error", True), "lost": ("error", True), "gone": ("error", True), "off": ("skipped", False)}


def test_suite_schema_is_stable(catalog):
    frame = suite([CheckSpec("a", "row_count", "people"), CheckSpec("b", "uniqueness", "people", "id")], catalog)
    assert {f.name: f.dataType.simpleString() for f in frame.schema} == RESULT_FIELDS
    only_fixed = suite([CheckSpec("off", "row_count", "people", active=False)], catalog)
    assert {f.name: f.dataType.simpleString() for f in only_fixed.schema} == RESULT_FIELDS
    with pytest.raises(SpecError):
        suite([], catalog)


def test_suite_splits_wide_fusions(catalog):
    specs = [CheckSpec(f"c{i}", "null_check", "people", "name", parameters=CheckParameters(max_null_count=i)) for i in range(70)]
    got = suite(specs, catalog).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"passed": 69, "failed": 1}


def test_view_target_and_view_placeholder(catalog):
    catalog.add_view(ViewSpec("named", ViewDefinition(base_table="people", filters=[{"column": "name", "operator": "is_not_null"}])))
    assert one(catalog, spec("row_count", "people", view_id="named")).actual_value == 2
    assert status(catalog, spec("custom_sql", "", view_id="named", custom_sql="SELECT COUNT(*) FROM _view", expected_value="2")) == "passed"


def test_execute_isolates_runtime_errors_and_replaces_runs(catalog, tmp_path):
    specs = [
        CheckSpec("fine", "row_count", "people"), CheckSpec("off", "row_count", "people", active=False),
        CheckSpec("boom", "custom_sql", parameters=CheckParameters(custom_sql="SELECT CAST(name AS INT) FROM people WHERE name = 'ann'")),
    ]
    for _ in range(2):
        got = execute(specs, catalog, str(tmp_path / "results"), "run-1")
    assert rows(got, "check_id", "status") == [("boom", "error"), ("fine", "passed")]
    execute(specs[:1], catalog, str(tmp_path / "results"), "run-2")
    assert catalog.spark.read.parquet(str(tmp_path / "results")).count() == 3


def test_select_checks():
    checks = [CheckSpec("a", "row_count", datasource_id="d1", tenant_id="t1"), CheckSpec("b", "row_count", datasource_id="d2", active=False)]
    assert [c.id for c in select_checks(checks, datasource_id="d2")] == ["b"]
    assert [c.id for c in select_checks(checks, tenant_id="t1")] == ["a"]
    assert [c.id for c in select_checks(checks, check_ids=["b", "a", "b", "zzz"])] == ["b", "a", "b", "zzz"]


def test_specs_from_json():
    check = CheckSpec.from_dict(
        {"id": "x", "type": "null_check", "table": "users", "column": "email", "severity": "critical", "parameters": {"max_null_percentage": 0},
         "threshold": {"type": "absolute", "value": 0}}
    )
    assert check.parameters.limit("max_null_percentage") is None and check.active
    with pytest.raises(SpecError):
        CheckSpec.from_dict({"id": "x", "type": "row_count", "tabel": "users"})


def test_moments_do_not_depend_on_the_session_time_zone(spark):
    from assayer.functions.expressions import as_instant, epoch_micros, utc_instant
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    zoned, plain = T.TimestampType(), T.TimestampNTZType()
    # The hour that New York has twice in autumn.
    moments = ["2023-11-05 05:30:00", "2023-11-05 06:30:00", "1969-07-20 20:17:40.5"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        table = spark.createDataFrame([(m,) for m in moments], "m string").select(F.col("m").cast("timestamp_ntz").alias("n"))
        there = table.select("n", as_instant(F.col("n"), plain).alias("t"))
        back = there.select("n", utc_instant(F.col("t"), zoned).alias("b"), epoch_micros(F.col("t"), zoned).alias("x"), epoch_micros(F.col("n"), plain).alias("y"))
        got = back.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert all(r.n == r.b and r.x == r.y for r in got)
    assert len({r.x for r in got}) == 3
