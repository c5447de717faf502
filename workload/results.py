"""Result, execution and alert queries over operational tables derived from the given ones.

check results   one per event: the user is the check, the event type its status
checks          one per customer: fifteen customers to a tenant, ten to a datasource
executions      one per order: the customer is the schedule, its line items the requested checks
schedules       one per customer, alerting two channels
channels        one per supplier: type, minimum severity and settings follow from its keys
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import utc_instant
from assayer.operators import alerts, executions, results
from assayer.operators.skew import top_k
from assayer.session import run_dir
from assayer.sources import history, sinks
from workload.base import query, table

# --------------------------------------------------------------------------- derived tables

RESULTS_SQL = """
    SELECT event_id AS result_id, 'check-' || user_id AS check_id, ts AS executed_at,
           CASE event_type WHEN 'click' THEN 'passed' WHEN 'view' THEN 'passed' WHEN 'purchase' THEN 'warning'
                WHEN 'error' THEN 'failed' ELSE 'error' END AS status
    FROM events"""
CHECKS_SQL = """
    SELECT 'check-' || c_custkey AS check_id, 'tenant-' || (c_custkey // 15) AS tenant_id, 'ds-' || (c_custkey // 10) AS datasource_id,
           c_acctbal > 0 AS active,
           CASE c_mktsegment WHEN 'MACHINERY' THEN 'critical' WHEN 'BUILDING' THEN 'high' WHEN 'AUTOMOBILE' THEN 'medium'
                WHEN 'FURNITURE' THEN 'low' ELSE 'info' END AS severity
    FROM customer"""
REQUESTS_SQL = "SELECT l_orderkey AS execution_id, l_partkey AS check_id FROM lineitem"
RUN_RESULTS_SQL = """
    SELECT l_orderkey AS execution_id, l_partkey AS check_id,
           CASE WHEN l_returnflag = 'A' THEN 'passed' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed'
                WHEN l_returnflag = 'R' THEN 'warning' WHEN l_linestatus = 'F' THEN 'skipped' ELSE 'error' END AS status,
           CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE 'info' END AS severity
    FROM lineitem, (VALUES (0.0), (0.06)) tries(t) WHERE l_discount > 0 AND l_tax >= t"""
LOST_SQL = f"""
    SELECT execution_id, SUM(asked)::BIGINT AS total_checks, SUM(GREATEST(asked - got, 0))::BIGINT AS lost
    FROM (SELECT execution_id, check_id, SUM(a) AS asked, SUM(g) AS got
          FROM (SELECT execution_id, check_id, 1 AS a, 0 AS g FROM ({REQUESTS_SQL})
                UNION ALL SELECT execution_id, check_id, 0, 1 FROM ({RUN_RESULTS_SQL})) GROUP BY 1, 2) GROUP BY 1"""
SUMMARY_SQL = f"""
    SELECT q.execution_id, total_checks, COALESCE(passed, 0) AS passed_checks, COALESCE(failed, 0) AS failed_checks,
           COALESCE(warning, 0) AS warning_checks, COALESCE(error, 0) + lost AS error_checks,
           COALESCE(skipped, 0) AS skipped_checks, worst,
           CASE worst WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' END
               AS max_failed_severity,
           CASE WHEN COALESCE(error, 0) + lost > 0 THEN 'partial' ELSE 'completed' END AS status
    FROM ({LOST_SQL}) q
    LEFT JOIN (
        SELECT execution_id, COUNT(*) AS got, COUNT(*) FILTER (WHERE status = 'passed') AS passed,
               COUNT(*) FILTER (WHERE status = 'failed') AS failed, COUNT(*) FILTER (WHERE status = 'warning') AS warning,
               COUNT(*) FILTER (WHERE status = 'error') AS error, COUNT(*) FILTER (WHERE status = 'skipped') AS skipped,
               MAX(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END)
                   FILTER (WHERE status = 'failed') AS worst
        FROM ({RUN_RESULTS_SQL}) GROUP BY 1
    ) r ON q.execution_id = r.execution_id"""
CHANNELS_SQL = """
    SELECT 'ch-' || s_suppkey AS channel_id, 'tenant-' || (s_suppkey // 2) AS tenant_id, s_acctbal > 0 AS active,
           ['email', 'slack', 'webhook', 'pagerduty', 'msteams', 'opsgenie', 'pigeon'][1 + s_suppkey % 7] AS channel_type,
           ['critical', 'high', 'medium', 'low', 'info', 'whatever'][1 + s_suppkey % 6] AS min_severity,
           CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'https://hooks.example.com/' || s_suppkey END AS setting
    FROM supplier"""
ALERTS_SQL = f"""
    SELECT e.execution_id || ':' || ch AS alert_id, ch AS channel_id, e.execution_id, o_custkey AS schedule_id,
           'tenant-' || (o_custkey // 15) AS tenant_id, 'Data Quality Check Failures - ' || c_name AS title,
           failed_checks || ' of ' || total_checks || ' checks failed' AS message, max_failed_severity, o_orderdate AS started_at
    FROM (
        SELECT s.*, o_custkey, o_orderdate, c_name,
               UNNEST(['ch-' || (c_custkey % 10), 'ch-' || (c_custkey % 97)]) AS ch
        FROM ({SUMMARY_SQL}) s JOIN orders ON execution_id = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE failed_checks > 0
    ) e"""
RANK = "CASE {} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE {} END"


def check_results(spark, sf_dir):
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("click", "view"), "passed").when(kind == "purchase", "warning").when(kind == "error", "failed").otherwise("error")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("result_id"), F.concat(F.lit("check-"), "user_id").alias("check_id"),
        F.col("ts").alias("executed_at"), status.alias("status"),
    )


def tenant_of(key, size=15):
    return F.concat(F.lit("tenant-"), F.floor(F.col(key) / size))


def checks(spark, sf_dir):
    segment = F.col("c_mktsegment")
    severity = (
        F.when(segment == "MACHINERY", "critical").when(segment == "BUILDING", "high").when(segment == "AUTOMOBILE", "medium")
        .when(segment == "FURNITURE", "low").otherwise("info")
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("check-"), "c_custkey").alias("check_id"),
        tenant_of("c_custkey").alias("tenant_id"),
        F.concat(F.lit("ds-"), F.floor(F.col("c_custkey") / 10)).alias("datasource_id"),
        (F.col("c_acctbal") > 0).alias("active"),
        severity.alias("severity"),
    )


def requests(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("execution_id"), F.col("l_partkey").alias("check_id"))


def run_results(spark, sf_dir):
    flag, line, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    status = (
        F.when(flag == "A", "passed").when((flag == "R") & (line == "F"), "failed").when(flag == "R", "warning")
        .when(line == "F", "skipped").otherwise("error")
    )
    severity = (
        F.when(number == 1, "critical").when(number == 2, "high").when(number == 3, "medium").when(number == 4, "low").otherwise("info")
    )
    # High taxes are tried twice, so that retries leave more than one result of a check.
    tries = F.explode(F.when(F.col("l_tax") >= 0.06, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return table(spark, sf_dir, "lineitem").where("l_discount > 0").withColumn("try", tries).select(
        F.col("l_orderkey").alias("execution_id"), F.col("l_partkey").alias("check_id"), status.alias("status"), severity.alias("severity")
    )


def summaries(spark, sf_dir):
    return executions.execution_summary(requests(spark, sf_dir), run_results(spark, sf_dir))


def schedules(spark, sf_dir):
    channel = lambda n: F.concat(F.lit("ch-"), F.col("c_custkey") % n)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("schedule_id"), F.col("c_name").alias("name"),
        tenant_of("c_custkey").alias("tenant_id"),
        F.array(channel(10), channel(97)).alias("alert_channel_ids"),
    )


def channels(spark, sf_dir):
    key = F.col("s_suppkey")
    pick = lambda words: F.get(F.array(*[F.lit(w) for w in words]), (key % len(words)).cast("int"))
    setting = F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("https://hooks.example.com/"), key))
    names = [name for name, _ in alerts.REQUIRED_SETTING.values()]
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ch-"), key).alias("channel_id"), tenant_of("s_suppkey", 2).alias("tenant_id"),
        (F.col("s_acctbal") > 0).alias("active"),
        pick(["email", "slack", "webhook", "pagerduty", "msteams", "opsgenie", "pigeon"]).alias("type"),
        pick(["critical", "high", "medium", "low", "info", "whatever"]).alias("min_severity"),
        F.create_map(*[x for n in names for x in (F.lit(n), setting)]).alias("configuration"),
    )


def started(spark, sf_dir):
    """Execution summaries with their schedule and start time."""
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("schedule_id"), F.col("o_orderdate").alias("started_at")
    )
    return summaries(spark, sf_dir).join(runs, "execution_id")


def failure_alerts(spark, sf_dir, severity="high"):
    return alerts.failure_alerts(started(spark, sf_dir), schedules(spark, sf_dir), severity)


# --------------------------------------------------------------------------- result history


@query(
    "result_history",
    f"""SELECT * FROM ({RESULTS_SQL}) QUALIFY ROW_NUMBER() OVER (PARTITION BY check_id ORDER BY executed_at DESC, result_id DESC) <= 5""",
)
def result_history(spark, sf_dir):
    return results.history(check_results(spark, sf_dir), 5, "result_id")


@query(
    "result_history_deep",
    f"""SELECT * FROM ({RESULTS_SQL}) QUALIFY ROW_NUMBER() OVER (PARTITION BY check_id ORDER BY executed_at DESC, result_id DESC) <= 1500""",
)
def result_history_deep(spark, sf_dir):
    """More rows per check than map tasks may keep: salted first pass."""
    return results.history(check_results(spark, sf_dir), 1500, "result_id")


@query(
    "result_last_status",
    f"SELECT check_id, MAX(executed_at) AS last_run_at, ARG_MAX(status, executed_at) AS last_status FROM ({RESULTS_SQL}) GROUP BY 1",
)
def result_last_status(spark, sf_dir):
    return results.last_status(check_results(spark, sf_dir), "result_id")


STATE_SQL = f"""
    SELECT c.*, last_run_at, COALESCE(last_status, 'pending') AS last_status FROM ({CHECKS_SQL}) c LEFT JOIN (
        SELECT check_id, MAX(executed_at) AS last_run_at, ARG_MAX(status, executed_at) AS last_status FROM ({RESULTS_SQL}) GROUP BY 1
    ) s ON c.check_id = s.check_id"""


@query("result_check_state", STATE_SQL)
def result_check_state(spark, sf_dir):
    return results.check_state(checks(spark, sf_dir), check_results(spark, sf_dir), "result_id")


@query("result_failed_per_tenant", f"SELECT tenant_id, COUNT(*) AS failed_checks FROM ({STATE_SQL}) WHERE last_status = 'failed' GROUP BY 1")
def result_failed_per_tenant(spark, sf_dir):
    return results.failed_per_tenant(results.check_state(checks(spark, sf_dir), check_results(spark, sf_dir), "result_id"))


@query(
    "result_recent_active",
    f"""SELECT * FROM ({RESULTS_SQL}) WHERE check_id IN (SELECT check_id FROM ({CHECKS_SQL}) WHERE active)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY check_id ORDER BY executed_at DESC, result_id DESC) <= 10""",
)
def result_recent_active(spark, sf_dir):
    return results.recent_results(checks(spark, sf_dir), check_results(spark, sf_dir), 10, "result_id")


@query("result_scoped", f"SELECT * FROM ({CHECKS_SQL}) WHERE tenant_id = 'tenant-7' AND datasource_id = 'ds-11'")
def result_scoped(spark, sf_dir):
    return results.scoped(checks(spark, sf_dir), "tenant-7", "ds-11")


# --------------------------------------------------------------------------- executions


@query("execution_summary", f"SELECT * EXCLUDE (worst) FROM ({SUMMARY_SQL})")
def execution_summary(spark, sf_dir):
    return summaries(spark, sf_dir)


@query(
    "execution_requested_checks",
    f"""
    WITH s AS (SELECT c_custkey AS schedule_id, CASE WHEN c_custkey % 3 = 0 THEN 'ds-' || (c_custkey // 10) ELSE '' END AS datasource_id,
                      CASE WHEN c_custkey % 2 = 0 THEN 'tenant-' || (c_custkey // 15) ELSE '' END AS tenant_id,
                      ['check-' || c_custkey, 'check-' || (c_custkey + 1), 'check-' || c_custkey] AS check_ids FROM customer)
    SELECT o_orderkey AS execution_id, s.schedule_id, UNNEST(check_ids) AS check_id
    FROM orders JOIN s ON o_custkey = s.schedule_id WHERE datasource_id = ''
    UNION ALL
    SELECT o_orderkey, s.schedule_id, c.check_id FROM orders JOIN s ON o_custkey = s.schedule_id
    JOIN ({CHECKS_SQL}) c ON c.datasource_id = s.datasource_id
    WHERE s.datasource_id <> '' AND (s.tenant_id = '' OR s.tenant_id = c.tenant_id)
    """,
)
def execution_requested_checks(spark, sf_dir):
    key = F.col("c_custkey")
    named = lambda k: F.concat(F.lit("check-"), k)
    plans = table(spark, sf_dir, "customer").select(
        key.alias("schedule_id"),
        F.when(key % 3 == 0, F.concat(F.lit("ds-"), F.floor(key / 10))).otherwise("").alias("datasource_id"),
        F.when(key % 2 == 0, tenant_of("c_custkey")).otherwise("").alias("tenant_id"),
        F.array(named(key), named(key + 1), named(key)).alias("check_ids"),
    )
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("schedule_id"))
    return executions.requested_checks(runs, plans, checks(spark, sf_dir))


@query(
    "execution_history",
    """SELECT o_orderkey AS execution_id, o_custkey AS schedule_id, o_orderdate AS started_at FROM orders
       QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3""",
)
def execution_history(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("schedule_id"), F.col("o_orderdate").alias("started_at")
    )
    return executions.execution_history(runs, 3)


# --------------------------------------------------------------------------- alerts

ALERT_COLUMNS = ["alert_id", "channel_id", "execution_id", "schedule_id", "tenant_id", "title", "message", "severity"]


@query("alert_rows", f"SELECT {', '.join(ALERT_COLUMNS[:-1])}, 'high' AS severity FROM ({ALERTS_SQL})")
def alert_rows(spark, sf_dir):
    return failure_alerts(spark, sf_dir).select(*ALERT_COLUMNS)


@query("alert_rows_max_severity", f"SELECT {', '.join(ALERT_COLUMNS[:-1])}, max_failed_severity AS severity FROM ({ALERTS_SQL})")
def alert_rows_max_severity(spark, sf_dir):
    return failure_alerts(spark, sf_dir, "max_failed").select(*ALERT_COLUMNS)


ROUTED_SQL = f"""
    SELECT a.alert_id, a.channel_id, c.channel_type, a.max_failed_severity AS severity, c.min_severity, c.setting, a.title, a.message,
           a.schedule_id, a.execution_id, a.started_at
    FROM ({ALERTS_SQL}) a JOIN ({CHANNELS_SQL}) c ON a.channel_id = c.channel_id
    WHERE c.active AND {RANK.format('a.max_failed_severity', 0)} >= {RANK.format('c.min_severity', 1)}"""


@query("alert_routing", f"SELECT alert_id, channel_id, channel_type, severity, min_severity FROM ({ROUTED_SQL})")
def alert_routing(spark, sf_dir):
    routed = alerts.route(failure_alerts(spark, sf_dir, "max_failed"), channels(spark, sf_dir))
    return routed.select("alert_id", "channel_id", "channel_type", "severity", "min_severity")


@query(
    "alert_broadcast_tenant",
    f"""SELECT a.execution_id, c.channel_id, c.channel_type FROM
        (SELECT DISTINCT execution_id, tenant_id FROM ({ALERTS_SQL})) a JOIN ({CHANNELS_SQL}) c ON a.tenant_id = c.tenant_id
        WHERE c.active AND 4 >= {RANK.format('c.min_severity', 1)}""",
)
def alert_broadcast_tenant(spark, sf_dir):
    one_each = failure_alerts(spark, sf_dir).select("execution_id", "tenant_id", "severity").distinct()
    return alerts.route_to_tenant(one_each, channels(spark, sf_dir)).select("execution_id", "channel_id", "channel_type")


ERROR_SQL = """
    CASE WHEN channel_type = 'pigeon' THEN 'unsupported channel type: pigeon'
         WHEN setting = '' THEN CASE channel_type WHEN 'email' THEN 'no email addresses configured'
             WHEN 'slack' THEN 'slack webhook URL not configured' WHEN 'webhook' THEN 'webhook URL not configured'
             WHEN 'pagerduty' THEN 'PagerDuty routing key not configured' WHEN 'msteams' THEN 'MS Teams webhook URL not configured'
             ELSE 'OpsGenie API key not configured' END END"""
COLOR_SQL = """CASE severity WHEN 'critical' THEN '#FF0000' WHEN 'high' THEN '#FF6600' WHEN 'medium' THEN '#FFCC00'
               WHEN 'low' THEN '#0066FF' WHEN 'info' THEN '#00CC00' ELSE '#808080' END"""


@query(
    "alert_deliveries",
    f"""SELECT alert_id, channel_id, channel_type, CASE WHEN {ERROR_SQL} IS NULL THEN 'ready' ELSE 'failed' END AS status,
               {ERROR_SQL} AS error,
               CASE WHEN {ERROR_SQL} IS NULL THEN CASE channel_type WHEN 'pagerduty' THEN 'https://events.pagerduty.com/v2/enqueue'
                    WHEN 'opsgenie' THEN 'https://api.opsgenie.com/v2/alerts' ELSE setting END END AS target,
               CASE WHEN {ERROR_SQL} IS NULL AND channel_type <> 'email' THEN 'application/json' END AS content_type,
               CASE WHEN {ERROR_SQL} IS NULL AND channel_type = 'opsgenie' THEN 'GenieKey ' || setting END AS "authorization"
        FROM ({ROUTED_SQL})""",
)
def alert_deliveries(spark, sf_dir):
    routed = alerts.route(failure_alerts(spark, sf_dir, "max_failed"), channels(spark, sf_dir))
    return alerts.deliveries(routed).select(
        "alert_id", "channel_id", "channel_type", "status", "error", "target",
        F.col("headers")["Content-Type"].alias("content_type"), F.col("headers")["Authorization"].alias("authorization"),
    )


@query(
    "alert_payload_teams",
    f"""SELECT alert_id, CAST(json_object('@type', 'MessageCard', '@context', 'http://schema.org/extensions', 'themeColor', {COLOR_SQL},
            'summary', title, 'sections', json_array(json_object('activityTitle', title, 'facts', json_array(
                json_object('name', 'Severity', 'value', severity), json_object('name', 'Message', 'value', message))))) AS VARCHAR) AS payload
        FROM ({ROUTED_SQL}) WHERE channel_type = 'msteams' AND setting <> ''""",
)
def alert_payload_teams(spark, sf_dir):
    routed = alerts.route(failure_alerts(spark, sf_dir, "max_failed"), channels(spark, sf_dir))
    sent = alerts.deliveries(routed.where("channel_type = 'msteams'"))
    return sent.where("status = 'ready'").select("alert_id", "payload")


@query(
    "alert_payload_fields",
    f"""SELECT alert_id, channel_type,
            CASE channel_type WHEN 'slack' THEN '*' || title || '*' || chr(10) || message WHEN 'opsgenie' THEN title
                 WHEN 'pagerduty' THEN title WHEN 'webhook' THEN title ELSE title END AS headline,
            CASE channel_type WHEN 'slack' THEN 'Severity' WHEN 'opsgenie' THEN message WHEN 'pagerduty' THEN message WHEN 'webhook' THEN message
                 WHEN 'email' THEN message END AS body,
            CASE channel_type WHEN 'slack' THEN {COLOR_SQL}
                 WHEN 'opsgenie' THEN CASE severity WHEN 'critical' THEN 'P1' WHEN 'high' THEN 'P2' WHEN 'medium' THEN 'P3' WHEN 'low' THEN 'P4' ELSE 'P5' END
                 WHEN 'pagerduty' THEN CASE severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'info' END
                 WHEN 'webhook' THEN severity END AS level
        FROM ({ROUTED_SQL}) WHERE channel_type IN ('slack', 'opsgenie', 'pagerduty', 'webhook', 'email') AND setting <> ''""",
)
def alert_payload_fields(spark, sf_dir):
    routed = alerts.route(failure_alerts(spark, sf_dir, "max_failed"), channels(spark, sf_dir))
    sent = alerts.deliveries(routed.where(F.col("channel_type").isin("slack", "opsgenie", "pagerduty", "webhook", "email")))
    read = lambda path: F.get_json_object("payload", path)
    by = lambda slack, ops, pager, hook, mail: (
        F.when(F.col("channel_type") == "slack", read(slack)).when(F.col("channel_type") == "opsgenie", read(ops))
        .when(F.col("channel_type") == "pagerduty", read(pager)).when(F.col("channel_type") == "email", read(mail)).otherwise(read(hook))
    )
    return sent.where("status = 'ready'").select(
        "alert_id", "channel_type",
        by("$.text", "$.message", "$.payload.summary", "$.title", "$.subject").alias("headline"),
        by("$.attachments[0].fields[0].title", "$.description", "$.payload.custom_details.message", "$.message", "$.body").alias("body"),
        by("$.attachments[0].color", "$.priority", "$.payload.severity", "$.severity", "$.level").alias("level"),
    )


HISTORY_SQL = f"""
    SELECT alert_id, channel_id, CASE WHEN {ERROR_SQL} IS NULL THEN 'sent' ELSE 'failed' END AS status, {ERROR_SQL} AS error, started_at AS sent_at
    FROM ({ROUTED_SQL})"""


def _history(spark, sf_dir):
    routed = alerts.route(failure_alerts(spark, sf_dir, "max_failed"), channels(spark, sf_dir))
    return alerts.alert_history(alerts.deliveries(routed), utc_instant(F.col("timestamp"), T.TimestampType()))


@query(
    "alert_history",
    f"""SELECT DISTINCT * FROM ({HISTORY_SQL}) QUALIFY DENSE_RANK() OVER (PARTITION BY channel_id ORDER BY sent_at DESC, alert_id DESC) <= 4""",
)
def alert_history(spark, sf_dir):
    return alerts.last_alerts(_history(spark, sf_dir).distinct(), 4)


@query(
    "alert_history_channel",
    f"""SELECT DISTINCT * FROM ({HISTORY_SQL}) WHERE channel_id = 'ch-4' ORDER BY sent_at DESC, alert_id DESC LIMIT 20""",
)
def alert_history_channel(spark, sf_dir):
    return alerts.last_alerts(_history(spark, sf_dir).distinct(), 20, "ch-4")


# --------------------------------------------------------------------------- limits above the usual


@query(
    "result_history_full",
    f"""SELECT * FROM (SELECT check_id, executed_at, result_id, status FROM ({RESULTS_SQL}) r)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY status ORDER BY executed_at DESC, result_id DESC) <= 1500""",
)
def result_history_full(spark, sf_dir):
    """The last 1500 results of every status, of a table that carries a map as stored results do."""
    rows = check_results(spark, sf_dir).withColumn("details", F.create_map(F.lit("status"), F.col("status")))
    kept = top_k(rows, ["status"], [F.col("executed_at").desc(), F.col("result_id").desc()], 1500)
    return kept.select("check_id", "executed_at", "result_id", F.col("details")["status"].alias("status"))


# --------------------------------------------------------------------------- the result table over many runs


@query(
    "result_table_folded",
    f"""SELECT check_id, status, DATE '1970-01-01' + CAST(date_diff('day', DATE '1970-01-01', executed_at::DATE) // 3 * 3 AS INTEGER) AS run_date,
               COUNT(*) AS results, MAX(executed_at) AS last_run_at
        FROM ({RESULTS_SQL}) GROUP BY 1, 2, 3""",
)
def result_table_folded(spark, sf_dir):
    """A run for every three days of results, its small files folded on the way. Every fourth run is first written
    with other statuses and repeated three runs later, when its first try has been folded."""
    path, fields = run_dir(spark, "result_table_folded"), "check_id string, status string, executed_at timestamp_ntz"
    found = check_results(spark, sf_dir).select("check_id", "status", "executed_at", F.lit(True).alias("stored"))
    part = F.floor(F.unix_date(F.to_date("executed_at")) / 3) * 3
    first, last = found.agg(F.min(part), F.max(part)).first()

    def write(start, **other):
        sinks.write_results(found.where(part == start).withColumns(other), path, f"from-{start}", start * 86400.0)

    for number, start in enumerate(range(first, last + 3, 3)):
        repeated = number % 4 == 0 and start + 9 <= last
        write(start, **({"status": F.lit("unknown")} if repeated else {}))
        if number % 4 == 3:
            write(start - 9)
        history.compact(spark, path, fields, fold=2, merge=2)
    kept = history.read_history(spark, path, fields)
    return kept.groupBy("check_id", "status", "run_date").agg(F.count(F.lit(1)).alias("results"), F.max("executed_at").alias("last_run_at"))
