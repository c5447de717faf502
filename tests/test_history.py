"""The result table over many runs: folded files, repeated runs, crashes, readers."""

import os

import pytest
from pyspark.sql import functions as F

from assayer.plans.catalog import Catalog
from assayer.plans.suite import compact_results, execute, results
from assayer.sources import history, sinks
from assayer.specs import CheckSpec
from tests.conftest import plan_of, rows

FIELDS = "check_id string, tenant_id string, status string"
DAY = 86400.0


def write(spark, path, run, *found, day=0):
    frame = spark.createDataFrame(list(found), FIELDS).withColumn("stored", F.lit(True))
    sinks.write_results(frame, path, run, day * DAY)


def held(spark, path, run=None):
    return rows(history.read_history(spark, path, FIELDS, run), "run_id", "check_id", "status")


def test_folds_stay_few_and_every_run_stays_as_it_was_last(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    for i in range(26):
        write(spark, path, f"r{i}", ("a", "t1", f"s{i}"), ("b", None, "passed"), day=i // 5)
        want[f"r{i}"] = f"s{i}"
        if i % 6 == 5:  # a run that was folded long ago, and one that is not yet
            for other in (i - 5, i):
                write(spark, path, f"r{other}", ("a", "t1", f"again{i}"))
                want[f"r{other}"] = f"again{i}"
        history.compact(spark, path, FIELDS, fold=3, merge=2)
        if i % 8 == 0 or i == 25:
            got = held(spark, path)
            assert {r: s for r, c, s in got if c == "a"} == want
            assert len(got) == sum(1 if s.startswith("again") else 2 for s in want.values())
    assert held(spark, path, "r0") == [("r0", "a", "again5")]
    assert held(spark, path, "r25") == [("r25", "a", "s25"), ("r25", "b", "passed")]
    assert held(spark, path, "nothing") == []
    folders = [n for n in os.listdir(path) if n.startswith("run_id=")]
    folds = os.listdir(os.path.join(path, history.FOLDS))
    assert len(folders) <= 6 and len(folds) <= 8


def test_a_compaction_that_breaks_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for run in ("1", "01", "a/b=c %", "ü"):
        write(spark, path, run, ("a", "t", run))
    before = held(spark, path)
    assert [r[0] for r in before] == sorted(["1", "01", "a/b=c %", "ü"]) and all(r == s for r, _, s in before)
    with monkeypatch.context() as broken:
        broken.setattr(history, "_write_manifest", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            history.compact(spark, path, FIELDS, fold=1)
    assert held(spark, path) == before
    assert history.compact(spark, path, FIELDS, fold=1)
    assert held(spark, path) == before
    assert not history.compact(spark, path, FIELDS, fold=1)
    write(spark, path, "2", ("a", "t", "2"))
    os.makedirs(os.path.join(path, "run_id=half"))  # a run without its _SUCCESS
    assert history.compact(spark, path, FIELDS, fold=1)
    assert held(spark, path) == sorted([*before, ("2", "a", "2")])
    assert sorted(n for n in os.listdir(path) if n.startswith("run_id=")) == ["run_id=2", "run_id=half"]


def test_a_date_prunes_folders_and_a_tenant_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        write(spark, path, str(i), ("a", "t1", "passed"), ("b", "t2", "failed"), day=i)
    history.compact(spark, path, FIELDS, fold=1)
    found = history.read_history(spark, path, FIELDS).where("run_date = date'1970-01-03' and tenant_id = 't2'")
    assert rows(found, "run_id", "status") == [("2", "failed")]
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(run_date" in plan and "EqualTo(tenant_id,t2)" in plan


def test_a_table_without_runs_has_no_rows(spark, tmp_path):
    assert held(spark, str(tmp_path / "none")) == []
    assert not history.compact(spark, str(tmp_path / "none"), FIELDS, fold=0)


def test_suites_are_read_back_from_folds(spark, tmp_path):
    catalog, path = Catalog(spark, {"t": spark.range(3)}), str(tmp_path / "t")
    for run in "abc":
        execute([CheckSpec("rows", "row_count", "t")], catalog, path, run)
    assert compact_results(spark, path, fold=3)
    found = results(spark, path)
    assert rows(found, "run_id", "actual_value") == [(r, 3.0) for r in "abc"]
    assert execute([CheckSpec("rows", "row_count", "t")], catalog, path, "b").count() == 1
    assert results(spark, path).count() == 3 and results(spark, path, "b").count() == 1
