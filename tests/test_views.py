"""View definitions: validation, filters, precedence, joins, unions, nesting."""

import pytest

from assayer.plans.catalog import Catalog
from assayer.plans.views import validate
from assayer.specs import FilterDef, JoinDef, OrderByDef, SelectDef, SpecError, ViewDefinition, ViewSpec
from tests.conftest import DATA, plan_of, rows


def view(catalog, **definition):
    catalog.add_view(ViewSpec("v", ViewDefinition(**definition)))
    return catalog.resolve("v")


@pytest.mark.parametrize(
    "definition, valid",
    [
        ({"sql": "SELECT 1"}, True),
        ({"base_table": "users"}, True),
        ({"union_tables": ["a", "b"]}, True),
        ({}, False),
        ({"base_table": "users", "joins": [{"table": "o", "type": "invalid", "on_condition": "x"}]}, False),
        ({"base_table": "users", "joins": [{"table": "", "type": "inner", "on_condition": "x"}]}, False),
        ({"base_table": "users", "joins": [{"table": "o", "type": "", "on_condition": "x"}]}, False),
        ({"base_table": "users", "joins": [{"table": "o", "type": "inner"}]}, False),
        ({"base_table": "users", "joins": [{"table": "o", "type": "cross"}]}, True),
        ({"base_table": "users", "joins": [{"table": "o", "type": "inner", "on_columns": ["a"]}]}, False),
        ({"base_table": "users", "filters": [{"column": "a", "operator": "invalid"}]}, False),
        ({"base_table": "users", "filters": [{"column": "", "operator": "eq"}]}, False),
        ({"base_table": "users", "filters": [{"column": "a", "operator": ""}]}, False),
        ({"base_table": "users", "filters": [{"column": "a", "operator": "in"}]}, False),
        ({"base_table": "users", "filters": [{"column": "a", "operator": "eq", "logical_op": "XOR"}]}, False),
        ({"union_tables": ["a"], "limit": 3}, False),
        ({"base_table": "users", "group_by": ["a"]}, False),
    ],
)
def test_validation(definition, valid):
    if valid:
        validate(ViewDefinition(**definition))
    else:
        with pytest.raises(SpecError):
            validate(ViewDefinition(**definition))


@pytest.mark.parametrize(
    "filter, amounts",
    [
        (FilterDef("name", "eq", "ann"), [10.0]),
        (FilterDef("name", "ne", "ann"), [None]),
        (FilterDef("amount", "lt", 20), [10.0]),
        (FilterDef("amount", "lte", 20), [10.0, 20.0]),
        (FilterDef("amount", "gt", "20"), [40.0]),
        (FilterDef("id", "gt", 1.5), [20.0, None]),
        (FilterDef("name", "eq", None), []),
        (FilterDef("name", "is_null"), [20.0, 40.0]),
        (FilterDef("name", "is_not_null"), [10.0, None]),
        (FilterDef("id", "in", values=[1, "2"]), [10.0, 20.0, None]),
        (FilterDef("id", "not_in", values=[1]), [20.0, None]),
        (FilterDef("id", "not_in", values=[1, None]), []),
        (FilterDef("name", "like", "%b"), [None]),
        (FilterDef("name", "eq", "x' OR 'a'='a"), []),
    ],
)
def test_filters(catalog, filter, amounts):
    got = [r.amount for r in view(catalog, base_table="people", filters=[filter]).collect()]
    assert sorted(got, key=str) == sorted(amounts, key=str)


def test_literals_must_fit_the_column(catalog):
    with pytest.raises(SpecError):
        view(catalog, base_table="people", filters=[FilterDef("id", "eq", "one")])


def test_and_binds_tighter_than_or(spark):
    catalog = Catalog(spark, {"orders": spark.read.parquet(f"{DATA}/orders.parquet")})
    filters = [FilterDef("o_orderstatus", "eq", "F"), FilterDef("o_orderstatus", "eq", "O", logical_op="OR"), FilterDef("o_totalprice", "gt", 400000)]
    assert view(catalog, base_table="orders", filters=filters).count() == 5939


def test_projection_names(catalog):
    columns = [SelectDef("id"), SelectDef("x", source_column="name"), SelectDef("double", expression="amount * 2"), SelectDef("id", alias="key")]
    assert view(catalog, base_table="people", columns=columns).columns == ["id", "name", "double", "key"]


def test_unknown_and_ambiguous_columns_are_rejected(catalog):
    with pytest.raises(SpecError):
        view(catalog, base_table="people", columns=[SelectDef("nope")])
    twice = JoinDef("people b", "inner", ("a.id", "b.id"))
    with pytest.raises(SpecError):
        view(catalog, base_table="people a", joins=[twice], columns=[SelectDef("name")])
    assert len(view(catalog, base_table="people a", joins=[twice]).columns) == 6


@pytest.mark.parametrize("kind, count", [("inner", 5), ("left", 6), ("right", 6), ("full", 7), ("cross", 16)])
def test_join_types(catalog, kind, count):
    on = () if kind == "cross" else ("a.id", "b.id")
    assert view(catalog, base_table="people a", joins=[JoinDef("people AS b", kind, on)]).count() == count


def test_join_condition_wins_over_pairs(catalog):
    joined = view(catalog, base_table="people a", joins=[JoinDef("people b", "inner", ("a.id", "b.id"), on_condition="a.amount < b.amount")])
    assert joined.count() == 3


def test_group_by_positions_aliases_and_hidden_keys(catalog):
    columns = [SelectDef("initial", expression="left(name, 1)"), SelectDef("n", expression="COUNT(*)")]
    assert len(rows(view(catalog, base_table="people", columns=columns, group_by=["1"]))) == 3
    assert len(rows(view(catalog, base_table="people", columns=columns, group_by=["initial"]))) == 3
    hidden = view(catalog, base_table="people", columns=[SelectDef("n", expression="COUNT(*)")], group_by=["id"])
    assert hidden.columns == ["n"] and rows(hidden) == [(1,), (1,), (2,)]


def test_order_puts_nulls_last_ascending(catalog):
    asc = view(catalog, base_table="people", order_by=[OrderByDef("amount", "asc")])
    assert [r.amount for r in asc.collect()] == [10.0, 20.0, 40.0, None]
    desc = view(catalog, base_table="people", order_by=[OrderByDef("amount", "DESC")], limit=2)
    assert [r.amount for r in desc.collect()] == [None, 40.0]
    assert "TakeOrderedAndProject" in plan_of(desc)


def test_union_needs_equal_types(catalog, spark):
    catalog.add_table("other", spark.createDataFrame([("x", "y", "z")], "a string, b string, c string"))
    assert view(catalog, union_tables=["people", "people"], union_all=True).count() == 8
    assert view(catalog, union_tables=["people", "people"]).count() == 4
    with pytest.raises(SpecError):
        view(catalog, union_tables=["people", "other"])


def test_views_nest_and_cycles_are_found(catalog):
    catalog.add_view(ViewSpec("inner_v", ViewDefinition(sql="SELECT id FROM people WHERE id IS NOT NULL")))
    assert view(catalog, sql="SELECT COUNT(*) AS n FROM inner_v JOIN inner_v AS again USING (id)").first().n == 5
    catalog.add_view(ViewSpec("x1", ViewDefinition(base_table="x2")))
    catalog.add_view(ViewSpec("x2", ViewDefinition(sql="SELECT * FROM x1")))
    with pytest.raises(SpecError, match="cycle"):
        catalog.resolve("x1")


def test_query_count_and_schema_of_views(catalog):
    catalog.add_view(ViewSpec("all", ViewDefinition(base_table="people")))
    catalog.add_view(ViewSpec("off", ViewDefinition(base_table="people"), active=False))
    assert catalog.query_view("all", 3).count() == 3
    assert catalog.count_view("all").first().row_count == 4
    assert rows(catalog.view_schema("all"), "name", "data_type") == [("amount", "double"), ("id", "bigint"), ("name", "string")]
    with pytest.raises(SpecError, match="inactive"):
        catalog.query_view("off")
    with pytest.raises(SpecError, match="not found"):
        catalog.query_view("none")


def test_catalogs_of_one_session_do_not_mix(spark):
    small, large = Catalog(spark, {"numbers": spark.range(3)}), Catalog(spark, {"numbers": spark.range(30)})
    for catalog, n in ((small, 3), (large, 30), (small, 3)):
        assert view(catalog, sql="SELECT COUNT(*) AS n FROM numbers").first().n == n
        assert catalog.sql("SELECT COUNT(*) AS numbers FROM numbers AS n").first()[0] == n


def test_a_view_may_share_its_name_with_a_column(catalog):
    catalog.add_view(ViewSpec("name", ViewDefinition(sql="SELECT name FROM people WHERE name IS NOT NULL")))
    assert catalog.query_view("name").count() == 2
