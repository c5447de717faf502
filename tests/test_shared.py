"""Views read by several parts of a suite are computed once."""

import os

import pytest

from assayer.plans.catalog import Catalog
from assayer.plans.shared import Uses, costly, shared_views
from assayer.plans.suite import FUSE_LIMIT, execute, suite
from assayer.session import shared_dir
from assayer.specs import CheckParameters, CheckSpec, SelectDef, ViewDefinition, ViewSpec


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(200).selectExpr("id", "id % 7 as grp", "id * 2 as amount", "cast(id as string) as note").write.parquet(str(tmp_path / "facts"))
    spark.range(5).selectExpr("id as grp", "'g' || id as name").write.parquet(str(tmp_path / "groups"))
    return tmp_path


def tables(spark, folder, *views):
    return Catalog(spark, {n: spark.read.parquet(str(folder / n)) for n in ("facts", "groups")}, views)


JOINED = ViewSpec("joined", ViewDefinition(base_table="facts f", joins=[{"table": "groups g", "type": "left", "on_columns": ["f.grp", "g.grp"]}], columns=[SelectDef("id"), SelectDef("amount"), SelectDef("note"), SelectDef("name")]), name="Joined")
PART = ViewSpec("part", ViewDefinition(base_table="joined", filters=[{"column": "amount", "operator": "gt", "value": 100}]))
CHECKS = [
    CheckSpec("rows", "row_count", view_id="joined"),
    CheckSpec("names", "null_check", view_id="joined", column="name"),
    CheckSpec("ids", "uniqueness", view_id="joined", column="id"),
    CheckSpec("some", "uniqueness", view_id="part", column="id"),
]


def results(df):
    return sorted((r.check_id, r.status, r.actual_value) for r in df.collect())


def test_one_join_for_all_parts(spark, folder):
    catalog = tables(spark, folder, JOINED, PART)
    apart = suite(CHECKS, catalog)
    with shared_views(CHECKS, catalog, FUSE_LIMIT) as shared:
        together = suite(CHECKS, shared)
        read = {os.path.dirname(f) for f in together.inputFiles()}
        assert len(read) == 1 and "view-joined" in read.pop()
        joins = [df._jdf.queryExecution().optimizedPlan().toString().count("LeftOuter") for df in (apart, together)]
        assert joins == [3, 0]
        assert results(together) == results(apart)
    left = [d for d in os.listdir(shared_dir(spark).removeprefix("file:")) if d.startswith("view-")]
    assert left == []


def test_execute_shares_and_cleans_up(spark, folder, tmp_path):
    got = execute(CHECKS, tables(spark, folder, JOINED, PART), str(tmp_path / "out"), "r1")
    assert results(got) == results(suite(CHECKS, tables(spark, folder, JOINED, PART)))
    assert not [d for d in os.listdir(shared_dir(spark).removeprefix("file:")) if d.startswith("view-")]


def uses(specs, *views):
    return Uses(specs, list(views), FUSE_LIMIT)


def test_what_is_worth_writing():
    names = lambda specs, *views: [v.id for v in uses(specs, *views).worth_writing()]
    assert names(CHECKS, JOINED, PART) == ["joined"]
    assert names(CHECKS[:2], JOINED, PART) == []  # one fused part
    assert names(CHECKS[3:], JOINED, PART) == []
    assert names([CHECKS[3], CheckSpec("o", "uniqueness", view_id="part", column="amount")], JOINED, PART) == ["joined"]
    plain = ViewSpec("plain", ViewDefinition(base_table="facts", filters=[{"column": "id", "operator": "gt", "value": 3}]))
    assert names([CheckSpec(str(i), "uniqueness", view_id="plain", column="id") for i in range(3)], plain) == []
    sql = CheckSpec("q", "custom_sql", parameters=CheckParameters(custom_sql="select count(*) from JOINED"))
    assert names([CHECKS[2], sql], JOINED) == ["joined"]
    ref = CheckSpec("r", "referential_integrity", "facts", "id", parameters=CheckParameters(reference_table="Joined", reference_column="id"))
    assert names([CHECKS[2], ref], JOINED) == ["joined"]
    assert names([CHECKS[2], CheckSpec("x", "uniqueness", view_id="joined", column="id", active=False)], JOINED) == []
    many = [CheckSpec(str(i), "null_check", view_id="joined", column="id") for i in range(FUSE_LIMIT + 1)]
    assert names(many, JOINED) == ["joined"]


def test_a_view_under_a_written_one_counts_once():
    above = ViewSpec("above", ViewDefinition(base_table="joined", group_by=["name"], columns=[SelectDef("name"), SelectDef(expression="COUNT(*)", alias="n")]))
    twice = [CheckSpec(str(i), "uniqueness", view_id="above", column="name") for i in range(2)]
    assert [v.id for v in uses(twice, JOINED, above).worth_writing()] == ["above"]
    also = [*twice, CheckSpec("j", "uniqueness", view_id="joined", column="id")]
    assert [v.id for v in uses(also, JOINED, above).worth_writing()] == ["joined", "above"]
    loop = [ViewSpec("a", ViewDefinition(base_table="b", limit=1)), ViewSpec("b", ViewDefinition(base_table="a", limit=1))]
    assert len(uses([], *loop).worth_writing()) == 0


def test_only_checked_columns_are_written(spark, folder):
    catalog = tables(spark, folder, JOINED)
    with shared_views(CHECKS[:3], catalog, FUSE_LIMIT) as shared:
        assert shared.resolve("joined").columns == ["id", "name"] and shared.resolve("Joined").columns == ["id", "name"]
    schema = CheckSpec("s", "column_count", view_id="joined", parameters=CheckParameters(expected_columns=4))
    with shared_views([*CHECKS[:3], schema], catalog, FUSE_LIMIT) as shared:
        assert len(shared.resolve("joined").columns) == 4


def test_broken_views_leave_their_checks_to_err(spark, folder, tmp_path):
    bad = ViewSpec("bad", ViewDefinition(sql="SELECT id, raise_error('no') AS x FROM facts"))
    specs = [CheckSpec(c, "uniqueness", view_id="bad", column=c) for c in ("id", "x")] + [CheckSpec("ok", "row_count", "facts")]
    got = {r.check_id: r.status for r in execute(specs, tables(spark, folder, bad), str(tmp_path / "out"), "r").collect()}
    assert got["x"] == "error" and got["ok"] == "passed"
    assert not costly(ViewDefinition(base_table="facts")) and costly(bad.definition)
