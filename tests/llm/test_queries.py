"""Every query against its SQL counterpart: on the given tables, on corner cases, and on empty tables."""

import duckdb
import pytest

import corpus_pipeline
from assayer.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import SCHEMAS
from tools.verify import rows_of


def compared(spark, folder, name):
    db = duckdb.connect()
    for t in SCHEMAS:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = QUERIES[name](spark, folder)
    answer = db.execute(ORACLES[name])
    columns, want = [c[0] for c in answer.description], answer.fetchall()
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, want)
    return want


@pytest.mark.parametrize("name", list(ORACLES))
def test_given_tables(spark, name):
    assert compared(spark, SMALL, name)


@pytest.mark.parametrize("name", list(ORACLES))
def test_corner_cases(spark, corner_dir, name):
    assert compared(spark, corner_dir, name)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    got = QUERIES[name](spark, empty_dir).collect()
    assert [r.conv_id for r in got] == ([-7] if name.startswith("op2_") else [])


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_on_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []
