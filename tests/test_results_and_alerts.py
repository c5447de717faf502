"""Histories, execution summaries, severity routing and payloads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from assayer.functions import severity
from assayer.operators import alerts, executions, results
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def log(spark):
    data = [("a", 1, at(1), "passed"), ("a", 2, at(2), "failed"), ("a", 3, at(2), "passed"), ("b", 4, at(1), "failed")]
    return spark.createDataFrame(data, "check_id string, result_id int, executed_at timestamp, status string")


def test_history_and_last_status(spark, log):
    assert rows(results.history(log, 2, "result_id"), "check_id", "result_id") == [("a", 2), ("a", 3), ("b", 4)]
    assert rows(results.last_status(log, "result_id"), "check_id", "last_status") == [("a", "passed"), ("b", "failed")]
    checks = spark.createDataFrame([("a", "t1", True), ("b", "t1", False), ("c", "t2", True)], "check_id string, tenant_id string, active boolean")
    state = results.check_state(checks, log, "result_id")
    assert rows(state, "check_id", "last_status") == [("a", "passed"), ("b", "failed"), ("c", "pending")]
    assert rows(results.failed_per_tenant(state)) == [("t1", 1)]
    assert rows(results.recent_results(checks, log, 1, "result_id"), "result_id") == [(3,)]
    assert results.scoped(checks, "t1").count() == 2 and results.scoped(checks).count() == 3


def test_execution_summary_counts_lost_checks_as_errors(spark):
    asked = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "b"), ("x", "gone"), ("y", "a"), ("z", "a")], "execution_id string, check_id string")
    got = spark.createDataFrame(
        [("x", "a", "failed", "low"), ("x", "b", "failed", "high"), ("x", "b", "skipped", "critical"), ("y", "a", "failed", "low"), ("z", "a", "passed", "low")],
        "execution_id string, check_id string, status string, severity string",
    )
    found = {r.execution_id: r for r in executions.execution_summary(asked, got).collect()}
    x = found["x"]
    assert (x.total_checks, x.failed_checks, x.skipped_checks, x.error_checks, x.status, x.max_failed_severity) == (4, 2, 1, 1, "partial", "high")
    assert found["y"].status == "completed" and found["z"].max_failed_severity is None


def test_execution_status_of_unlisted_checks(spark):
    frame = spark.createDataFrame([(0, None), (2, None), (0, "no such datasource")], "errors int, problem string")
    got = frame.select(executions.execution_status(F.col("errors"), F.col("problem")).alias("s"))
    assert [r.s for r in got.collect()] == ["completed", "partial", "failed"]


@pytest.mark.parametrize(
    "alert, minimum, sent",
    [("critical", "critical", True), ("critical", "high", True), ("critical", "info", True), ("high", "critical", False), ("medium", "high", False),
     ("info", "critical", False), ("info", "info", True), ("low", "whatever", True), ("unheard", "info", False)],
)
def test_severity_matrix(spark, alert, minimum, sent):
    assert spark.range(1).select(severity.meets_threshold(F.lit(alert), F.lit(minimum)).alias("s")).first().s is sent


def test_severity_labels(spark):
    words = ["critical", "high", "medium", "low", "info", "unheard"]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    labels = frame.select("i", severity.color(F.col("w")).alias("c"), severity.pagerduty(F.col("w")).alias("p"), severity.opsgenie(F.col("w")).alias("o"))
    got = labels.orderBy("i").collect()
    assert [r.p for r in got] == ["critical", "error", "warning", "info", "info", "info"]
    assert [r.o for r in got] == ["P1", "P2", "P3", "P4", "P5", "P5"]
    assert got[0].c == "#FF0000" and got[-1].c == "#808080"


@pytest.fixture
def routed(spark):
    runs = spark.createDataFrame(
        [("e1", "s1", 4, 2, 1, 0, 1, 0, "critical", T0), ("e2", "s1", 4, 4, 0, 0, 0, 0, None, T0), ("e3", "s1", 1, 0, 0, 0, 1, 0, None, T0)],
        "execution_id string, schedule_id string, total_checks long, passed_checks long, failed_checks long, warning_checks long, "
        "error_checks long, skipped_checks long, max_failed_severity string, started_at timestamp",
    )
    kinds = ["email", "slack", "webhook", "pagerduty", "msteams", "opsgenie", "pigeon"]
    plans = spark.createDataFrame([("s1", "t1", "nightly", kinds + ["bare", "off", "strict", "lost"])], "schedule_id string, tenant_id string, name string, alert_channel_ids array<string>")
    full = {name: "setting" for name, _ in alerts.REQUIRED_SETTING.values()}
    rows = [(k, "t1", k, "info", True, full) for k in kinds]
    rows += [("bare", "t1", "slack", "info", True, {}), ("off", "t1", "slack", "info", False, full), ("strict", "t1", "slack", "critical", True, full),
             ("other", "t2", "slack", "info", True, full)]
    channels = spark.createDataFrame(rows, "channel_id string, tenant_id string, type string, min_severity string, active boolean, configuration map<string,string>")
    return runs, plans, channels


def test_only_failures_alert_and_critical_channels_stay_silent_by_default(routed):
    runs, plans, channels = routed
    made = alerts.failure_alerts(runs, plans)
    assert {r.execution_id for r in made.collect()} == {"e1"}
    first = made.where("channel_id = 'slack'").first()
    assert first.title == "Data Quality Check Failures - nightly" and first.message == "1 of 4 checks failed" and first.severity == "high"
    sent = {r.channel_id for r in alerts.route(made, channels).collect()}
    assert sent == {"email", "slack", "webhook", "pagerduty", "msteams", "opsgenie", "pigeon", "bare"}
    worst = alerts.failure_alerts(runs, plans, "max_failed")
    assert "strict" in {r.channel_id for r in alerts.route(worst, channels).collect()}


def test_tenant_broadcast(routed):
    runs, plans, channels = routed
    one = alerts.failure_alerts(runs, plans).limit(1)
    assert {r.channel_id for r in alerts.route_to_tenant(one, channels).collect()} == {
        "email", "slack", "webhook", "pagerduty", "msteams", "opsgenie", "pigeon", "bare"}


def test_payloads_and_history(routed):
    runs, plans, channels = routed
    sent = {r.channel_id: r for r in alerts.deliveries(alerts.route(alerts.failure_alerts(runs, plans), channels)).collect()}
    assert sent["pigeon"].status == "failed" and sent["pigeon"].error == "unsupported channel type: pigeon"
    assert sent["bare"].error == "slack webhook URL not configured" and sent["bare"].payload is None
    read = {k: json.loads(r.payload) for k, r in sent.items() if r.payload}
    slack = read["slack"]
    assert slack["text"] == "*Data Quality Check Failures - nightly*\n1 of 4 checks failed"
    fields = {f["title"]: f["value"] for f in slack["attachments"][0]["fields"]}
    assert slack["attachments"][0]["color"] == "#FF6600" and fields["Severity"] == "high" and fields["Schedule ID"] == "s1" and fields["schedule"] == "nightly"
    assert read["pagerduty"]["event_action"] == "trigger" and read["pagerduty"]["payload"]["severity"] == "error"
    assert read["pagerduty"]["payload"]["timestamp"] == "2024-01-01T00:00:00Z"
    assert read["msteams"]["@type"] == "MessageCard" and read["msteams"]["sections"][0]["facts"][0] == {"name": "Severity", "value": "high"}
    assert read["opsgenie"]["priority"] == "P2" and read["opsgenie"]["details"]["schedule"] == "nightly"
    assert read["webhook"]["id"] == "e1:webhook" and "check_id" not in read["webhook"]
    assert sent["opsgenie"].target == alerts.OPSGENIE_URL and sent["webhook"].method == "POST"


def test_alert_history(spark):
    data = [("a1", "c1", "ready", None, at(1)), ("a2", "c1", "failed", "no URL", at(2)), ("a3", "c2", "ready", None, at(3)), ("a4", "c1", "ready", None, at(4))]
    sent = spark.createDataFrame(data, "alert_id string, channel_id string, status string, error string, at timestamp")
    kept = alerts.alert_history(sent, F.col("at"))
    assert rows(kept, "alert_id", "status") == [("a1", "sent"), ("a2", "failed"), ("a3", "sent"), ("a4", "sent")]
    assert rows(alerts.last_alerts(kept, 2), "alert_id") == [("a2",), ("a3",), ("a4",)]
    assert rows(alerts.last_alerts(kept, 2, "c1"), "alert_id") == [("a2",), ("a4",)]
