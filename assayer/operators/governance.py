"""Policies as table jobs: quality gates, masking, retention, access decisions, compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.expressions import as_instant, utc_now
from assayer.specs import SpecError

# Rules of the standard quality policy.
QUALITY_RULES = {"completeness_threshold": 0.95, "accuracy_threshold": 0.98, "consistency_checks": True}

# Personal data in free text.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"

ACCURACY_CHECKS = ("regex", "format", "range", "set_membership")


def quality_gate(results: DataFrame, policies: DataFrame) -> DataFrame:
    """Allow or refuse each dataset by the quality policy of its tenant.

    The last result of every check counts. Completeness is the worst non-null share, accuracy the
    worst share of valid values, consistency that all referential checks passed. A measure without
    checks does not refuse, but one whose check ended in an error does: it is not known. Datasets
    without an active policy are allowed, with NULL as their policy.
    """
    kind, share = F.col("check_type"), F.col("actual_value") / 100.0
    judged = kind.isin("null_check", "referential_integrity", *ACCURACY_CHECKS)
    if "executed_at" in results.columns:
        fields = ["table_name", "check_type", "actual_value", "status"]
        latest = F.max_by(F.struct(*fields), F.struct("executed_at", "status")).alias("r")
        results = results.groupBy("tenant_id", "check_id").agg(latest).select("tenant_id", "r.*")
    measured = results.groupBy("tenant_id", F.col("table_name").alias("dataset")).agg(
        F.min(F.when(kind == "null_check", F.lit(1.0) - share)).alias("completeness"),
        F.min(F.when(kind.isin(*ACCURACY_CHECKS), share)).alias("accuracy"),
        F.min(F.when(kind == "referential_integrity", F.col("status") == "passed")).alias("consistent"),
        F.count_if(judged & (F.col("status") == "error")).alias("errors"),
    )
    ok = (
        F.coalesce(F.col("completeness") >= F.col("completeness_threshold"), F.lit(True))
        & F.coalesce(F.col("accuracy") >= F.col("accuracy_threshold"), F.lit(True))
        & (~F.col("consistency_checks") | F.coalesce(F.col("consistent"), F.lit(True)))
        & (F.col("errors") == 0)
    )
    allowed = F.when(F.col("_policed"), ok).otherwise(F.lit(True))
    policed = policies.where("active").withColumn("_policed", F.lit(True))
    return measured.join(policed, "tenant_id", "left").select(
        "tenant_id", "dataset", "completeness", "accuracy", "consistent", allowed.alias("allowed")
    )


def mask(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Replace personal data column by column, keeping the column order.

    ``email`` hides addresses inside text, ``hash`` replaces the value by its SHA-256,
    ``redact`` by asterisks, ``null`` by NULL.
    """
    def masked(name: str) -> Column:
        col, rule = F.col(name), rules.get(name)
        if rule is None:
            return col
        if rule == "email":
            return F.regexp_replace(col, EMAIL_PATTERN, "***@***").alias(name)
        if rule == "hash":
            return F.sha2(col.cast("string"), 256).alias(name)
        if rule == "redact":
            return F.when(col.isNotNull(), F.lit("***")).alias(name)
        if rule == "null":
            return F.lit(None).cast(df.schema[name].dataType).alias(name)
        raise SpecError(f"unknown masking rule {rule!r}")

    unknown = set(rules) - set(df.columns)
    if unknown:
        raise SpecError(f"no such columns to mask: {sorted(unknown)}")
    return df.select(*[masked(c) for c in df.columns])


def contains_personal_data(col: Column) -> Column:
    return col.rlike(EMAIL_PATTERN)


def _retention_bound(df: DataFrame, column: str, days: int, as_of: str | None) -> Column:
    """The oldest moment to keep, in the column's own type, so that the filter reaches the scan."""
    bound = utc_now(as_of) - F.make_dt_interval(F.lit(days))
    is_instant = isinstance(df.schema[column].dataType, T.TimestampType)
    return as_instant(bound, T.TimestampNTZType()) if is_instant else bound


def within_retention(df: DataFrame, column: str, days: int, as_of: str | None = None) -> DataFrame:
    """Rows young enough to keep. The bound is a constant, so it prunes files and row groups."""
    return df.where(F.col(column) >= _retention_bound(df, column, days, as_of))


def past_retention(df: DataFrame, column: str, days: int, as_of: str | None = None) -> DataFrame:
    return df.where(F.col(column) < _retention_bound(df, column, days, as_of))


def _glob(pattern: Column) -> Column:
    """A resource pattern with ``*`` wildcards as a LIKE pattern."""
    escaped = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.replace(escaped, F.lit("*"), F.lit("%"))


def access_decisions(requests: DataFrame, policies: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Decide requests (request_id, policy_id, subject, action, resource, context) in bulk.

    An unknown policy is an error and denied; an inactive one denies; an active one without
    rules allows. With rules (policy_id, effect, actions, resources, field, operator, value)
    a matching deny wins, then a matching allow, and no match denies. A pattern that does not
    compile matches nothing if it would allow, and everything if it would deny.

    Rules are found by an index: see ``rule_index``.
    """
    known = requests.join(
        policies.select("policy_id", F.col("active").alias("_active")), "policy_id", "left"
    )
    if rules is None:
        verdicts = known.withColumn("_rules", F.lit(0)).withColumn("_deny", F.lit(False)).withColumn("_allow", F.lit(False))
    else:
        indexed = rule_index(rules)
        known = known.join(_looked_up(rules, indexed), "policy_id", "left")
        tally = fitting_rules(known, indexed).where(_rule_matches()).groupBy("request_id").agg(
            F.bool_or(F.col("effect") == "deny").alias("_deny"),
            F.bool_or(F.col("effect") == "allow").alias("_allow"),
        )
        verdicts = known.join(tally, "request_id", "left")
    has_rules = F.coalesce(F.col("_rules"), F.lit(0)) > 0
    deny, allow = F.coalesce("_deny", F.lit(False)), F.coalesce("_allow", F.lit(False))
    reason = (
        F.when(F.col("_active").isNull(), F.lit("policy not found"))
        .when(~F.col("_active"), F.lit("policy is not active"))
        .when(has_rules & deny, F.lit("denied by rule"))
        .when(has_rules & ~allow, F.lit("no rule matches"))
        .otherwise(F.lit("policy evaluation passed"))
    )
    return verdicts.withColumn("reason", reason).select(
        "request_id", "policy_id", (F.col("reason") == "policy evaluation passed").alias("allowed"), "reason"
    )


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules by what a request must have for them to fit: policy, action, and the start of its resource.

    A rule is there once for each of its actions (``*`` for any) and resource patterns, under the text
    in front of the pattern's first ``*``; a rule without patterns fits every resource, NULL as well. ``_sound`` says whether a condition's pattern compiles; every
    pattern is tried by the task that has the rule.
    """
    starred = (F.size("actions") == 0) | F.array_contains("actions", F.lit("*"))
    actions = F.when(starred, F.array(F.lit("*"))).otherwise(F.array_distinct("actions"))
    patterns = F.when(F.size("resources") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct("resources"))
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("value")).isNotNull()
    sound = rules.withColumn("_sound", F.when(F.col("operator") == "matches", compiles).otherwise(F.lit(True)))
    each = sound.withColumn("_action", F.explode(actions)).withColumn("_pattern", F.explode(patterns))
    return each.select("policy_id", "_action", F.coalesce(F.substring_index("_pattern", "*", 1), F.lit("")).alias("_prefix"), "_pattern", "effect", "field", "operator", "value", "_sound")


def _looked_up(rules: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per policy the number of its rules, and which keys its index has: any action or not, and length of the prefix."""
    shape = F.struct((F.col("_action") == "*").alias("any"), F.length("_prefix").alias("length"))
    shapes = indexed.groupBy("policy_id").agg(F.collect_set(shape).alias("_shapes"))
    return rules.groupBy("policy_id").agg(F.count(F.lit(1)).alias("_rules")).join(shapes, "policy_id", "left")


def fitting_rules(requests: DataFrame, indexed: DataFrame) -> DataFrame:
    """Requests with ``_shapes``, each with the rules whose policy, action and prefix fit it."""
    keys = F.transform(
        F.filter("_shapes", lambda s: s["length"] <= F.length(F.coalesce("resource", F.lit("")))),
        lambda s: F.struct(F.when(s["any"], F.lit("*")).otherwise(F.col("action")).alias("_action"), F.substr(F.coalesce("resource", F.lit("")), F.lit(1), s["length"]).alias("_prefix")),
    )
    asked = requests.select("request_id", "policy_id", "resource", "subject", "context", F.explode(F.array_distinct(keys)).alias("k"))
    return asked.select("request_id", "policy_id", "resource", "subject", "context", "k.*").join(indexed, ["policy_id", "_action", "_prefix"])


def _rule_matches() -> Column:
    resource_ok = F.col("_pattern").isNull() | F.like(F.col("resource"), _glob(F.col("_pattern")))
    actual = F.when(F.col("field") == "subject", F.col("subject")).otherwise(F.col("context")[F.col("field")])
    test = (
        F.when(F.col("operator") == "equals", actual == F.col("value"))
        .when(F.col("operator") == "contains", F.contains(actual, F.col("value")))
        .when((F.col("operator") == "matches") & F.col("_sound"), F.regexp(actual, F.col("value")))
        .otherwise(F.lit(False))
    )
    broken_deny = (F.col("operator") == "matches") & ~F.col("_sound") & (F.col("effect") == "deny")
    test = F.when(broken_deny, F.lit(True)).otherwise(test)
    condition_ok = F.col("field").isNull() | F.coalesce(test, F.lit(False))
    return F.coalesce(resource_ok & condition_ok, F.lit(False))


def compliance_gaps(datasets: DataFrame, policies: DataFrame, lineage: DataFrame, audits: DataFrame) -> DataFrame:
    """Datasets (tenant_id, dataset) that miss what their tenant's frameworks demand.

    ``lineage`` and ``audits`` list the datasets (tenant_id, dataset) that have it. One row per gap.
    """
    bound = datasets.join(
        policies.where("active").select("tenant_id", "framework", "audit_required", "lineage_tracking"), "tenant_id"
    )
    own = ["tenant_id", "dataset"]
    no_lineage = bound.where("lineage_tracking").join(lineage.select(*own), own, "left_anti")
    no_audit = bound.where("audit_required").join(audits.select(*own), own, "left_anti")
    row = lambda df, gap: df.select("tenant_id", "framework", "dataset", F.lit(gap).alias("gap"))
    return row(no_lineage, "lineage").union(row(no_audit, "audit"))
