"""Every registered query against its SQL counterpart in DuckDB."""

import pytest

import __spark_entry__ as contract
from tests.conftest import SMALL
from tools.verify import connect, rows_of
from workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        assert got
        return
    answer = duck.execute(ORACLES[name])
    columns, want = [c[0] for c in answer.description], answer.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, got) == rows_of(columns, want)


def test_entry(spark):
    assert contract.entry(spark).count() == 16


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
