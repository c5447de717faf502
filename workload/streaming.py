"""Streaming queries: the given files as a stream, run to completion, results read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import as_instant, utc_instant
from assayer.operators import workflow
from assayer.plans import suite
from assayer.session import run_dir
from assayer.streaming import microbatch, replay, windows
from workload.base import Threshold, catalog, query, spec, table
from workload.workflow import EVENT_LOG_SQL, event_log, replay_sql


DAYS = 8
PART_SQL = f"date_diff('day', (SELECT MIN(ts)::DATE FROM events), ts::DATE) // {DAYS}"


def in_batches(spark, sf_dir, start, late=None):
    """Run a streaming query over events in the order of time, one micro-batch per span of DAYS days.

    Every span is written to the stream's folder, then the query is started on it, runs to its end and
    stops, so that state, late rows and restarts from the checkpoint all take part. Rows of the
    condition ``late`` come one span later.
    """
    events, root = table(spark, sf_dir, "events"), run_dir(spark, "events")
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    part = F.floor(F.date_diff(F.to_date("ts"), F.lit(first)) / DAYS)
    if late is not None:
        part = part + late.cast("bigint")
    for number in range((last - first).days // DAYS + (1 if late is None else 2)):
        events.where(part == number).write.mode("append").parquet(root)
        start(spark.readStream.schema(events.schema).parquet(root)).awaitTermination()


CHECKS = [
    spec("rows", "row_count", min_rows=320),
    spec("value", "range", column="value", expected_max=50.0),
    spec("kind", "set_membership", column="event_type", allowed_values=["click", "view", "purchase", "signup"]),
]

METRICS_SQL = """
    COUNT(*) AS rows_row_count, CASE WHEN COUNT(*) < 320 THEN 'failed' ELSE 'passed' END AS rows_status,
    COUNT(*) AS value_total_count, COUNT(*) FILTER (WHERE value BETWEEN 0 AND 50) AS value_in_range_count,
    COUNT(*) FILTER (WHERE NOT value BETWEEN 0 AND 50) AS value_out_of_range_count,
    CAST(COUNT(*) FILTER (WHERE value BETWEEN 0 AND 50) AS DOUBLE) / COUNT(*) * 100 AS value_in_range_percentage,
    CASE WHEN COUNT(*) FILTER (WHERE value BETWEEN 0 AND 50) < COUNT(*) THEN 'failed' ELSE 'passed' END AS value_status,
    COUNT(*) AS kind_total_count, COUNT(*) FILTER (WHERE event_type <> 'error') AS kind_valid_count,
    COUNT(*) FILTER (WHERE event_type = 'error') AS kind_invalid_count,
    CAST(COUNT(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) / COUNT(*) * 100 AS kind_valid_percentage,
    CASE WHEN COUNT(*) FILTER (WHERE event_type = 'error') > 0 THEN 'failed' ELSE 'passed' END AS kind_status"""


@query(
    "stream_suite",
    f"""
    WITH e AS (SELECT *, {PART_SQL} AS part FROM events)
    SELECT 'rows' AS check_id, 'passed' AS status, CAST(COUNT(*) AS DOUBLE) AS actual_value FROM e GROUP BY part
    UNION ALL SELECT 'users', CASE WHEN COUNT(c_custkey) = COUNT(*) THEN 'passed' ELSE 'failed' END, CAST(COUNT(c_custkey) AS DOUBLE) / COUNT(*) * 100
        FROM e LEFT JOIN customer ON user_id = c_custkey GROUP BY part
    UNION ALL SELECT 'ids', 'passed', CAST(COUNT(DISTINCT event_id) AS DOUBLE) / COUNT(*) * 100 FROM e GROUP BY part
    """,
)
def stream_suite(spark, sf_dir):
    out, state = run_dir(spark, "stream_suite"), run_dir(spark, "stream_suite_state")
    specs = [
        spec("rows", "row_count", "events"),
        spec("users", "referential_integrity", "events", "user_id", reference_table="customer", reference_column="c_custkey"),
        spec("ids", "uniqueness", "events", "event_id"),
    ]
    in_batches(spark, sf_dir, lambda events: microbatch.run_on_stream(events, "events", specs, catalog(spark, sf_dir), out, state, fold=2))
    return suite.results(spark, out).select("check_id", "status", "actual_value")


def _windowed(spark, sf_dir, name: str, slide: str | None, lateness: str):
    out, state = run_dir(spark, name), run_dir(spark, f"{name}_state")
    schemas = []

    def start(events):
        timed = events.withColumn("ts", as_instant(F.col("ts"), T.TimestampNTZType()))
        metrics = windows.windowed_checks(timed, CHECKS, "ts", "1 day", slide, lateness)
        schemas.append(metrics.schema)
        return windows.write_windows(metrics, out, state)

    in_batches(spark, sf_dir, start)
    return spark.read.schema(schemas[-1]).parquet(out).withColumns(
        {c: utc_instant(F.col(c), T.TimestampType()) for c in ("window_start", "window_end")}
    )


@query(
    "stream_tumbling_windows",
    f"""
    SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, {METRICS_SQL}
    FROM events GROUP BY 1, 2 HAVING window_end <= (SELECT date_trunc('milliseconds', MAX(ts)) FROM events) - INTERVAL 1 HOUR
    """,
)
def stream_tumbling_windows(spark, sf_dir):
    return _windowed(spark, sf_dir, "stream_tumbling_windows", None, "1 hour")


@query(
    "stream_sliding_windows",
    f"""
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, {METRICS_SQL}
    FROM (SELECT *, UNNEST([time_bucket(INTERVAL 8 HOUR, ts), time_bucket(INTERVAL 8 HOUR, ts) - INTERVAL 8 HOUR,
                            time_bucket(INTERVAL 8 HOUR, ts) - INTERVAL 16 HOUR]) AS window_start FROM events)
    GROUP BY 1, 2 HAVING window_end <= (SELECT date_trunc('milliseconds', MAX(ts)) FROM events) - INTERVAL 1 HOUR
    """,
)
def stream_sliding_windows(spark, sf_dir):
    return _windowed(spark, sf_dir, "stream_sliding_windows", "8 hours", "1 hour")


LATE = 7
#: Rows that arrive before their window is closed, and the last watermark: one LATE-th of the rows comes a span later.
ARRIVED_SQL = f"""
    WITH e AS (SELECT *, {PART_SQL} + (event_id % {LATE} = 0)::INT AS arrival FROM events),
    marks AS (SELECT a.arrival, date_trunc('milliseconds', (SELECT MAX(ts) FROM e WHERE e.arrival < a.arrival)) - INTERVAL 1 HOUR AS mark
        FROM (SELECT DISTINCT arrival FROM e) a),
    kept AS (SELECT e.*, date_trunc('day', ts)::TIMESTAMP AS window_start FROM e JOIN marks USING (arrival)
        WHERE mark IS NULL OR date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY > mark),
    closed AS (SELECT * FROM kept WHERE window_start + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', MAX(ts)) FROM e) - INTERVAL 1 HOUR)"""


def _keyed(spark, sf_dir, name: str, one, added=None):
    """A keyed check by day over events in several batches, with rows that come late."""
    out, state = run_dir(spark, name), run_dir(spark, f"{name}_state")
    schemas = []

    def start(events):
        timed = events.withColumns({"ts": as_instant(F.col("ts"), T.TimestampNTZType()), **(added or {})})
        metrics = windows.windowed_keyed_check(timed, one, "ts", "1 day", None, "1 hour", catalog(spark, sf_dir))
        schemas.append(metrics.schema)
        return windows.write_windows(metrics, out, state)

    in_batches(spark, sf_dir, start, F.col("event_id") % LATE == 0)
    return spark.read.schema(schemas[-1]).parquet(out).withColumns(
        {c: utc_instant(F.col(c), T.TimestampType()) for c in ("window_start", "window_end")}
    )


@query(
    "stream_window_uniqueness",
    f"""{ARRIVED_SQL}
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, COUNT(*) AS total_count, COUNT(DISTINCT user_id) AS unique_count,
        COUNT(*) - COUNT(user_id) AS null_key_count, COUNT(*) - COUNT(DISTINCT user_id) AS duplicate_count,
        COUNT(DISTINCT user_id)::DOUBLE / COUNT(*) * 100 AS uniqueness_percentage,
        CASE WHEN COUNT(DISTINCT user_id)::DOUBLE / COUNT(*) * 100 < 90 THEN 'failed' ELSE 'passed' END AS status
    FROM closed GROUP BY 1""",
)
def stream_window_uniqueness(spark, sf_dir):
    """Exact distinct users of every day."""
    return _keyed(spark, sf_dir, "window_uniqueness", spec("u", "uniqueness", "events", "user_id", threshold=Threshold(type="percentage", value=90.0)))


@query(
    "stream_window_orphans",
    f"""{ARRIVED_SQL}
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, COUNT(*) AS total_count, COUNT(c_custkey) AS matched_count,
        COUNT(*) - COUNT(c_custkey) AS orphan_count, COUNT(c_custkey)::DOUBLE / COUNT(*) * 100 AS integrity_percentage,
        CASE WHEN COUNT(c_custkey) < COUNT(*) THEN 'failed' ELSE 'passed' END AS status
    FROM closed LEFT JOIN customer ON user_id * 2 = c_custkey GROUP BY 1""",
)
def stream_window_orphans(spark, sf_dir):
    """Users of every day whose doubled id is no customer."""
    one = spec("o", "referential_integrity", "events", "twice", reference_table="customer", reference_column="c_custkey")
    return _keyed(spark, sf_dir, "window_orphans", one, {"twice": F.col("user_id") * 2})


@query(
    "windowed_checks_batch",
    f"""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end, {METRICS_SQL}
        FROM events GROUP BY 1, 2""",
)
def windowed_checks_batch(spark, sf_dir):
    return windows.windowed_checks(table(spark, sf_dir, "events"), CHECKS, "ts", "6 hours")


@query("stream_replay", "SELECT entity, state, accepted, rejected FROM (" + replay_sql(EVENT_LOG_SQL, workflow.DATA_QUALITY) + ")")
def stream_replay(spark, sf_dir):
    """Latest state per entity, kept as a table that every micro-batch goes on with."""
    states, progress = run_dir(spark, "stream_replay"), run_dir(spark, "stream_replay_state")

    def start(events):
        log = event_log(spark, sf_dir, events)
        return replay.write_states(log, workflow.DATA_QUALITY, states, progress, compact_every=2)

    in_batches(spark, sf_dir, start)
    return replay.states(spark, states, workflow.DATA_QUALITY)
