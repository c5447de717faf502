"""Alerts: rows from failed executions, routing to channels, payloads, and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import severity as sev
from assayer.functions.expressions import as_instant, utc_instant
from assayer.operators.skew import top_k

# Public endpoints of the two hosted services.
PAGERDUTY_URL = "https://events.pagerduty.com/v2/enqueue"
OPSGENIE_URL = "https://api.opsgenie.com/v2/alerts"
ALERT_SOURCE = "assayer"

# The setting each channel type cannot do without, and the error when it is missing.
REQUIRED_SETTING = {
    "email": ("email_addresses", "no email addresses configured"),
    "slack": ("slack_webhook_url", "slack webhook URL not configured"),
    "webhook": ("webhook_url", "webhook URL not configured"),
    "pagerduty": ("pagerduty_routing_key", "PagerDuty routing key not configured"),
    "msteams": ("teams_webhook_url", "MS Teams webhook URL not configured"),
    "opsgenie": ("opsgenie_api_key", "OpsGenie API key not configured"),
}


def failure_alerts(executions: DataFrame, schedules: DataFrame, severity: str = "high") -> DataFrame:
    """One alert per failed execution and channel of its schedule.

    Errors alone do not alert. The severity is a constant, or with ``max_failed`` the
    highest severity among the failed checks.
    """
    level = F.col("max_failed_severity") if severity == "max_failed" else F.lit(severity)
    failed = executions.where(F.col("failed_checks") > 0)
    named = failed.join(schedules.select("schedule_id", "tenant_id", F.col("name").alias("schedule"), "alert_channel_ids"), "schedule_id")
    summary = F.to_json(F.struct(*[f"{s}_checks" for s in ("total", "passed", "failed", "warning", "error", "skipped")]))
    return named.select(
        F.explode("alert_channel_ids").alias("channel_id"),
        F.col("tenant_id"),
        F.concat(F.lit("Data Quality Check Failures - "), F.col("schedule")).alias("title"),
        F.concat(F.col("failed_checks"), F.lit(" of "), F.col("total_checks"), F.lit(" checks failed")).alias("message"),
        level.alias("severity"),
        "schedule_id",
        "execution_id",
        F.create_map(
            F.lit("summary"), summary, F.lit("schedule"), F.col("schedule"), F.lit("executed_at"), F.col("started_at").cast("string")
        ).alias("details"),
        as_instant(F.col("started_at"), executions.schema["started_at"].dataType).alias("timestamp"),
    ).withColumn("alert_id", F.concat_ws(":", "execution_id", "channel_id"))


def route(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """Alerts paired with their active channel when their severity reaches its minimum."""
    return _accepted(alerts.join(_channel(channels).drop("_tenant"), "channel_id"))


def route_to_tenant(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """Every alert to all active channels of its tenant."""
    own = _channel(channels)
    return _accepted(alerts.drop("channel_id").join(own, alerts["tenant_id"] == own["_tenant"]).drop("_tenant"))


def _channel(channels: DataFrame) -> DataFrame:
    return channels.where("active").select(
        "channel_id",
        F.col("tenant_id").alias("_tenant"),
        F.col("type").alias("channel_type"),
        F.col("min_severity"),
        F.col("configuration"),
    )


def _accepted(pairs: DataFrame) -> DataFrame:
    return pairs.where(sev.meets_threshold(F.col("severity"), F.col("min_severity")))


def _setting(name: str) -> Column:
    return F.coalesce(F.col("configuration")[name], F.lit(""))


def _by_type(values: dict[str, Column], default: Column) -> Column:
    expr = default
    for kind, value in values.items():
        expr = F.when(F.col("channel_type") == kind, value).otherwise(expr)
    return expr


def _slack() -> Column:
    field = lambda title, value: F.struct(title.alias("title"), value.alias("value"), F.lit(True).alias("short"))
    fields = F.array(field(F.lit("Severity"), F.col("severity")))
    schedule = F.when(
        F.coalesce(F.col("schedule_id"), F.lit("")) != "",
        F.array(field(F.lit("Schedule ID"), F.col("schedule_id"))),
    ).otherwise(F.slice(fields, 1, 0))
    details = F.transform(
        F.array_sort(F.map_entries("details")), lambda e: field(e["key"], F.coalesce(e["value"], F.lit("")))
    )
    return F.to_json(
        F.struct(
            F.concat(F.lit("*"), F.col("title"), F.lit("*\n"), F.col("message")).alias("text"),
            F.array(
                F.struct(sev.color(F.col("severity")).alias("color"), F.concat(fields, schedule, details).alias("fields"))
            ).alias("attachments"),
        )
    )


def _webhook() -> Column:
    optional = [c for c in ("schedule_id", "execution_id", "check_id")]
    return F.to_json(
        F.struct(
            F.col("alert_id").alias("id"),
            "title",
            "message",
            "severity",
            *[F.nullif(F.col(c), F.lit("")).alias(c) for c in optional],
            "details",
            _rfc3339().alias("timestamp"),
        )
    )


def _pagerduty() -> Column:
    return F.to_json(
        F.struct(
            _setting("pagerduty_routing_key").alias("routing_key"),
            F.lit("trigger").alias("event_action"),
            F.col("alert_id").alias("dedup_key"),
            F.struct(
                F.col("title").alias("summary"),
                sev.pagerduty(F.col("severity")).alias("severity"),
                F.lit(ALERT_SOURCE).alias("source"),
                _rfc3339().alias("timestamp"),
                F.struct("message", "details").alias("custom_details"),
            ).alias("payload"),
        )
    )


def _teams() -> Column:
    fact = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    return F.to_json(
        F.struct(
            F.lit("MessageCard").alias("@type"),
            F.lit("http://schema.org/extensions").alias("@context"),
            sev.color(F.col("severity")).alias("themeColor"),
            F.col("title").alias("summary"),
            F.array(
                F.struct(
                    F.col("title").alias("activityTitle"),
                    F.array(fact("Severity", F.col("severity")), fact("Message", F.col("message"))).alias("facts"),
                )
            ).alias("sections"),
        )
    )


def _opsgenie() -> Column:
    return F.to_json(
        F.struct(
            F.col("title").alias("message"),
            F.col("message").alias("description"),
            sev.opsgenie(F.col("severity")).alias("priority"),
            "details",
        )
    )


def _email() -> Column:
    return F.to_json(
        F.struct(
            _setting("email_addresses").alias("to"),
            F.col("title").alias("subject"),
            F.col("message").alias("body"),
        )
    )


def _rfc3339() -> Column:
    return F.date_format(utc_instant(F.col("timestamp"), T.TimestampType()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _headers() -> Column:
    """HTTP headers of a delivery. Those of a webhook's own setting (JSON text) win."""
    json = F.create_map(F.lit("Content-Type"), F.lit("application/json"))
    own = F.coalesce(F.from_json(_setting("webhook_headers"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(json, lambda k, _: ~F.map_contains_key(own, k))
    key = F.create_map(F.lit("Authorization"), F.concat(F.lit("GenieKey "), _setting("opsgenie_api_key")))
    none = F.lit(None).cast("map<string,string>")
    return _by_type({"webhook": F.map_concat(kept, own), "opsgenie": F.map_concat(json, key), "email": none}, json)


def deliveries(routed: DataFrame) -> DataFrame:
    """One row per delivery: where it goes, with which headers, and what it says, ready for any transport.

    A channel without its required setting, or of an unknown type, gives a ``failed`` row
    with the reason instead.
    """
    for name in ("check_id", "schedule_id", "execution_id"):
        known = F.col(name) if name in routed.columns else F.lit(None)
        routed = routed.withColumn(name, known.cast("string"))
    error = F.concat(F.lit("unsupported channel type: "), F.col("channel_type"))
    for kind, (setting, message) in REQUIRED_SETTING.items():
        missing = F.when(_setting(setting) == "", F.lit(message))
        error = F.when(F.col("channel_type") == kind, missing).otherwise(error)
    none = F.lit(None).cast("string")
    target = _by_type(
        {
            "email": _setting("email_addresses"),
            "slack": _setting("slack_webhook_url"),
            "webhook": _setting("webhook_url"),
            "pagerduty": F.lit(PAGERDUTY_URL),
            "msteams": _setting("teams_webhook_url"),
            "opsgenie": F.lit(OPSGENIE_URL),
        },
        none,
    )
    method = F.when(
        (F.col("channel_type") == "webhook") & (_setting("webhook_method") != ""), _setting("webhook_method")
    ).otherwise(F.lit("POST"))
    payload = _by_type(
        {
            "email": _email(),
            "slack": _slack(),
            "webhook": _webhook(),
            "pagerduty": _pagerduty(),
            "msteams": _teams(),
            "opsgenie": _opsgenie(),
        },
        none,
    )
    marked = routed.withColumn("error", error)
    ok = F.col("error").isNull()
    return marked.select(
        "alert_id",
        "channel_id",
        "channel_type",
        "severity",
        "title",
        "message",
        F.when(ok, F.lit("ready")).otherwise(F.lit("failed")).alias("status"),
        "error",
        F.when(ok, target).alias("target"),
        F.when(ok, method).alias("method"),
        F.when(ok, _headers()).alias("headers"),
        F.when(ok, payload).alias("payload"),
        "timestamp",
    )


def alert_history(sent: DataFrame, sent_at: Column) -> DataFrame:
    """History rows of deliveries: ``sent`` or ``failed`` with its error."""
    return sent.select(
        "alert_id",
        "channel_id",
        F.when(F.col("status") == "failed", F.lit("failed")).otherwise(F.lit("sent")).alias("status"),
        sent_at.alias("sent_at"),
        "error",
    )


def last_alerts(history: DataFrame, k: int, channel_id: str = "") -> DataFrame:
    """The last k alerts of one channel, or of each channel when none is named."""
    if channel_id:
        return history.where(F.col("channel_id") == channel_id).orderBy(F.col("sent_at").desc(), F.col("alert_id").desc()).limit(k)
    return top_k(history, ["channel_id"], [F.col("sent_at").desc(), F.col("alert_id").desc()], k)
