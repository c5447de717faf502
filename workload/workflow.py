"""Workflow queries: logs are the events of each user and the turns of each conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import workflow
from workload.base import query, table

EVENT_SQL = """CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'validate' WHEN 'purchase' THEN 'pass'
               WHEN 'error' THEN 'fail' ELSE 'retry' END"""

# A conversation starts idle; the system may open it, then user and assistant alternate.
DIALOGUE = workflow.Workflow(
    "dialogue",
    "idle",
    (
        ("system", ("idle",), "opened"),
        ("user", ("idle", "opened", "answered"), "asked"),
        ("assistant", ("asked",), "answered"),
    ),
)


def transitions_sql(flow: workflow.Workflow) -> str:
    rows = [f"('{event}', '{src}', '{dst}')" for event, sources, dst in flow.transitions for src in sources]
    return "(VALUES " + ", ".join(rows) + ")"


def replay_sql(log: str, flow: workflow.Workflow) -> str:
    return f"""
    WITH RECURSIVE log AS (
        SELECT entity, event, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY ts, event_id) AS i FROM ({log})
    ),
    t(event, src, dst) AS (SELECT * FROM {transitions_sql(flow)}),
    run(entity, i, state, accepted, rejected, first_rejected) AS (
        SELECT entity, 0::BIGINT, '{flow.initial}', 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM (SELECT DISTINCT entity FROM log)
        UNION ALL
        SELECT r.entity, l.i, COALESCE(t.dst, r.state), r.accepted + (t.dst IS NOT NULL)::BIGINT, r.rejected + (t.dst IS NULL)::BIGINT,
               COALESCE(r.first_rejected, CASE WHEN t.dst IS NULL THEN l.event END)
        FROM run r JOIN log l ON r.entity = l.entity AND l.i = r.i + 1
        LEFT JOIN t ON t.event = l.event AND t.src = r.state
    )
    SELECT entity, state, accepted, rejected, first_rejected FROM run QUALIFY ROW_NUMBER() OVER (PARTITION BY entity ORDER BY i DESC) = 1"""


EVENT_LOG_SQL = f"SELECT CAST(user_id AS VARCHAR) AS entity, {EVENT_SQL} AS event, ts, event_id FROM events"
TURN_LOG_SQL = "SELECT CAST(conv_id AS VARCHAR) AS entity, role AS event, TIMESTAMP '2024-01-01' AS ts, turn AS event_id FROM conversations"


def event_log(spark, sf_dir, events=None):
    kind = F.col("event_type")
    event = (
        F.when(kind == "click", "start").when(kind == "view", "validate").when(kind == "purchase", "pass")
        .when(kind == "error", "fail").otherwise("retry")
    )
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select(
        F.col("user_id").cast("string").alias("entity"), event.alias("event"), "ts", "event_id"
    )


def turn_log(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("entity"), F.col("role").alias("event"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.col("turn").alias("event_id"),
    )


@query("workflow_replay_events", replay_sql(EVENT_LOG_SQL, workflow.DATA_QUALITY))
def workflow_replay_events(spark, sf_dir):
    return workflow.replay(event_log(spark, sf_dir), workflow.DATA_QUALITY)


@query("workflow_replay_turns", replay_sql(TURN_LOG_SQL, DIALOGUE))
def workflow_replay_turns(spark, sf_dir):
    return workflow.replay(turn_log(spark, sf_dir), DIALOGUE)


STATE_SQL = "SELECT 'order-' || o_orderkey AS entity, CASE o_orderstatus WHEN 'F' THEN 'validating' WHEN 'O' THEN 'pending' ELSE 'failed' END AS state FROM orders"


def order_states(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), "o_orderkey").alias("entity"),
        F.when(status == "F", "validating").when(status == "O", "pending").otherwise("failed").alias("state"),
    )


@query(
    "workflow_available",
    f"SELECT s.entity, s.state, t.event, t.dst AS next_state FROM ({STATE_SQL}) s JOIN {transitions_sql(workflow.DATA_QUALITY)} t(event, src, dst) ON s.state = t.src",
)
def workflow_available(spark, sf_dir):
    return workflow.available_transitions(order_states(spark, sf_dir), workflow.DATA_QUALITY)


@query(
    "workflow_can_transition",
    f"""
    SELECT 'order-' || l_orderkey AS entity, s.state, CASE l_returnflag WHEN 'A' THEN 'start' WHEN 'R' THEN 'fail' ELSE 'retry' END AS event,
           t.dst IS NOT NULL AS allowed
    FROM lineitem JOIN ({STATE_SQL}) s ON s.entity = 'order-' || l_orderkey
    LEFT JOIN {transitions_sql(workflow.DATA_QUALITY)} t(event, src, dst)
      ON t.src = s.state AND t.event = CASE l_returnflag WHEN 'A' THEN 'start' WHEN 'R' THEN 'fail' ELSE 'retry' END
    """,
)
def workflow_can_transition(spark, sf_dir):
    flag = F.col("l_returnflag")
    asked = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("order-"), "l_orderkey").alias("entity"),
        F.when(flag == "A", "start").when(flag == "R", "fail").otherwise("retry").alias("event"),
    )
    return workflow.can_transition(asked, order_states(spark, sf_dir), workflow.DATA_QUALITY)


STANDARD_SQL = " UNION ALL ".join(
    f"SELECT '{w.name}' AS workflow, * FROM {transitions_sql(w)} t(event, src, dst)" for w in workflow.STANDARD
)


@query(
    "workflow_usage",
    f"""SELECT t.workflow, t.event, t.src, t.dst, COUNT(l.event_id) AS occurrences FROM ({STANDARD_SQL}) t
        LEFT JOIN ({EVENT_LOG_SQL}) l ON l.event = t.event GROUP BY 1, 2, 3, 4""",
)
def workflow_usage(spark, sf_dir):
    """How often the log holds the event of each standard transition."""
    counts = event_log(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    return workflow.transition_table(spark).join(counts, "event", "left").select(
        "workflow", "event", "src", "dst", F.coalesce("n", F.lit(0)).alias("occurrences")
    )
