"""Suites per micro-batch, windowed metrics, continuous replay."""

import datetime as dt

from assayer.operators import workflow
from assayer.plans.catalog import Catalog
from assayer.specs import CheckParameters, CheckSpec
from assayer.streaming import microbatch, replay, windows
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
LOG = "entity string, event string, ts timestamp, event_id long"


def feed(spark, path, schema, *batches):
    """A file stream that delivers one batch per file."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_suite_runs_on_every_batch_and_survives_a_restart(spark, tmp_path):
    source = feed(spark, tmp_path / "in", "id long, v string", [(1, "a"), (2, None)], [(3, "b")])
    specs = [CheckSpec("rows", "row_count", "t"), CheckSpec("nulls", "null_check", "t", "v", parameters=CheckParameters(max_null_count=10))]
    run = lambda: microbatch.run_on_stream(source, "t", specs, Catalog(spark), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.actual_value for r in got.where("check_id = 'rows'").collect()) == [1.0, 2.0]
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_late_rows_are_left_out_and_windows_close(spark, tmp_path):
    hour = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    first = [(hour(0, 10), 5.0), (hour(0, 50), -1.0), (hour(3), 1.0)]
    second = [(hour(0, 20), 9.0), (hour(6), 1.0)]
    source = feed(spark, tmp_path / "in", "ts timestamp, v double", first, second)
    specs = [CheckSpec("rows", "row_count"), CheckSpec("pos", "range", column="v", parameters=CheckParameters(expected_max=10.0))]
    metrics = windows.windowed_checks(source, specs, "ts", "1 hour", lateness="30 minutes")
    windows.write_windows(metrics, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "window_start", "rows_row_count", "pos_status")
    assert (hour(3), 1, "passed") in got
    closed = dict((start, n) for start, n, _ in got)
    assert closed[hour(0)] in (2, 3) and hour(6) not in closed


def test_continuous_replay_keeps_state_between_batches(spark, tmp_path):
    one = [("x", "submit", T0, 1), ("x", "review", T0, 2), ("y", "approve", T0, 3)]
    two = [("x", "approve", T0, 4), ("y", "submit", T0, 5)]
    source = feed(spark, tmp_path / "in", LOG, one, two)
    seen = {}

    def keep(batch, batch_id):
        seen[batch_id] = rows(batch, "entity", "state", "accepted", "rejected")

    query = replay.replay_stream(source, workflow.APPROVAL).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    final = {r[0]: r[1:] for _, batch in sorted(seen.items()) for r in batch}
    assert final == {"x": ("approved", 3, 0), "y": ("submitted", 1, 1)}


def test_states_go_on_from_the_table(spark, tmp_path):
    """Batches, restarts, repeats and compaction: the states are those of one replay of everything in order."""
    import random

    rng = random.Random(4)
    events = ["submit", "review", "approve", "reject", "unknown", None]
    batches = [[(rng.choice(["hot", "hot", "a", "b", "c", None]), rng.choice(events), T0 + dt.timedelta(hours=b, minutes=rng.randrange(50)), b * 1000 + i) for i in range(60)] for b in range(7)]
    states, progress = str(tmp_path / "states"), str(tmp_path / "progress")
    for at in range(0, 7, 3):
        source = feed(spark, tmp_path / "in", LOG, *batches[at : at + 3])
        replay.write_states(source, workflow.APPROVAL, states, progress, compact_every=2).awaitTermination()
    want = rows(workflow.replay(spark.createDataFrame([e for b in batches for e in b], LOG), workflow.APPROVAL), "entity", "state", "accepted", "rejected")
    read = lambda: rows(replay.states(spark, states, workflow.APPROVAL), "entity", "state", "accepted", "rejected")
    assert read() == want
    # The last batch once more, as after a crash: it starts from what was before it.
    replay.advance_states(spark.createDataFrame(batches[6], LOG), 6, workflow.APPROVAL, states, 2)
    assert read() == want
    left = sorted(d.name for d in (tmp_path / "states").iterdir())
    assert "base-5" in left and "base-1" not in left and len(left) <= 5
    # A batch that was not finished is not read.
    (tmp_path / "states" / "batch-7").mkdir()
    assert read() == want


def test_a_hot_entity_is_spread_over_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    n = 30_000
    log = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id") % 5000)).alias("entity"),
        F.lit("submit").alias("event"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"))
    per_task = workflow.stretches(log, workflow.APPROVAL, 12).groupBy(F.spark_partition_id()).agg(F.sum("total").alias("n"))
    sizes = sorted(r.n for r in per_task.collect())
    assert sum(sizes) == n and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    replay.advance_states(log, 0, workflow.APPROVAL, str(tmp_path / "states"))
    hot = replay.states(spark, str(tmp_path / "states"), workflow.APPROVAL).where("entity = 'hot'").first()
    assert (hot.state, hot.accepted, hot.rejected) == ("submitted", 1, n // 3 - 1)


def keyed(source, spec, tmp_path, name, catalog=None):
    metrics = windows.windowed_keyed_check(source, spec, "ts", "1 hour", None, "30 minutes", catalog)
    windows.write_windows(metrics, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    return metrics.sparkSession.read.schema(metrics.schema).parquet(str(tmp_path / name))


def one_by_one(spark, schema, batches, spec, tmp_path, name, catalog=None):
    """The query started anew for every batch, so that the watermark moves in between."""
    for batch in batches:
        found = keyed(feed(spark, tmp_path / f"{name}-in", schema, batch), spec, tmp_path, name, catalog)
    return found


def test_keyed_checks_in_windows_with_late_rows(spark, tmp_path):
    hour = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    first = [(hour(0, 1), "a"), (hour(0, 2), "a"), (hour(0, 59), None), (hour(1, 5), "b"), (hour(3), "c")]
    second = [(hour(0, 30), "z"), (hour(3, 10), "c"), (hour(2, 50), "a"), (hour(7), "d")]
    third = [(hour(2, 55), "late"), (hour(9), "e")]
    run = lambda one, name, known=None: one_by_one(spark, "ts timestamp, k string", (first, second, third), one, tmp_path, name, known)
    got = rows(run(CheckSpec("u", "uniqueness", column="k"), "unique"), "window_start", "total_count", "unique_count", "null_key_count", "status")
    assert got == [(hour(0), 3, 1, 1, "failed"), (hour(1), 1, 1, 0, "passed"), (hour(2), 1, 1, 0, "passed"), (hour(3), 2, 1, 0, "failed"), (hour(7), 1, 1, 0, "passed")]
    known = Catalog(spark, {"known": spark.createDataFrame([("a",), ("a",), ("c",)], "k string")})
    spec = CheckSpec("r", "referential_integrity", column="k", parameters=CheckParameters(reference_table="known", reference_column="k", count_mode="child"))
    got = rows(run(spec, "orphans", known), "window_start", "total_count", "matched_count", "orphan_count")
    assert got == [(hour(0), 3, 2, 1), (hour(1), 1, 0, 1), (hour(2), 1, 1, 0), (hour(3), 2, 2, 0), (hour(7), 1, 0, 1)]
    shares = CheckSpec("d", "distribution", column="k", parameters=CheckParameters(expected_distribution={"a": 1.0}))
    got = dict(rows(run(shares, "shares"), "window_start", "max_deviation"))
    assert got[hour(2)] == 0 and got[hour(3)] == 1


def test_references_that_are_a_stream(spark, tmp_path):
    hour = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    orders = feed(spark, tmp_path / "orders", "ts timestamp, k long", [(hour(0, 5), 1), (hour(0, 6), 2), (hour(1, 5), 1)], [(hour(5), 9)])
    known = feed(spark, tmp_path / "known", "ts timestamp, id long", [(hour(0, 50), 1), (hour(1, 1), 2)], [(hour(5), 9)])
    spec = CheckSpec("r", "referential_integrity", column="k", parameters=CheckParameters(reference_table="known", reference_column="id"))
    got = rows(keyed(orders, spec, tmp_path, "pairs", Catalog(spark, {"known": known})), "window_start", "total_count", "matched_count")
    assert got == [(hour(0), 2, 1), (hour(1), 1, 0)]


def test_keyed_checks_over_tables_agree_with_whole_table_checks(spark, tmp_path):
    import pytest

    from assayer.specs import SpecError

    table = spark.createDataFrame([(T0, i % 4) for i in range(10)], "ts timestamp, k long")
    one = windows.windowed_keyed_check(table, CheckSpec("u", "uniqueness", column="k"), "ts", "1 hour").first()
    assert (one.total_count, one.unique_count) == (10, 4)
    twice = windows.windowed_keyed_check(table, CheckSpec("u", "uniqueness", column="k"), "ts", "1 hour", "30 minutes").collect()
    assert [r.unique_count for r in twice] == [4, 4]
    with pytest.raises(SpecError):
        windows.windowed_keyed_check(table, CheckSpec("x", "row_count"), "ts", "1 hour")
