"""Policy and access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import access, governance
from assayer.plans.suite import suite
from workload.base import DOCUMENT_LABELS, catalog, query, spec, table

GATE = [
    spec("a", "null_check", view_id="document_labels", column="quality", tenant_id="0"),
    spec("b", "set_membership", view_id="document_labels", column="lang", tenant_id="0", allowed_values=["en", "de", "fr", "es"]),
    spec("c", "null_check", "customer", "c_name", tenant_id="1"),
    spec("d", "range", "customer", "c_acctbal", tenant_id="1", expected_min=-1000.0, expected_max=10000.0),
    spec("e", "referential_integrity", "customer", "c_nationkey", tenant_id="1", reference_table="nation", reference_column="n_nationkey"),
    spec("f", "regex", "part", "p_brand", tenant_id="2", pattern="^Brand#[0-9]+$"),
    spec("g", "referential_integrity", "orders", "o_orderkey", tenant_id="2", reference_table="lineitem", reference_column="l_orderkey"),
]


@query(
    "policy_quality_gate",
    """
    SELECT '0' AS tenant_id, 'document_labels' AS dataset,
           1.0 - (CAST(COUNT(*) FILTER (WHERE quality IS NULL) AS DOUBLE) / COUNT(*) * 100) / 100 AS completeness,
           (CAST(COUNT(*) FILTER (WHERE lang IN ('en', 'de', 'fr', 'es')) AS DOUBLE) / COUNT(*) * 100) / 100 AS accuracy,
           NULL::BOOLEAN AS consistent,
           1.0 - CAST(COUNT(*) FILTER (WHERE quality IS NULL) AS DOUBLE) / COUNT(*) >= 0.95 AS allowed
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL
    SELECT '1', 'customer', 1.0 - CAST(COUNT(*) FILTER (WHERE c_name IS NULL) AS DOUBLE) / COUNT(*),
           (CAST(COUNT(*) FILTER (WHERE c_acctbal BETWEEN -1000 AND 10000) AS DOUBLE) / COUNT(*) * 100) / 100,
           COUNT(n_nationkey) = COUNT(*), TRUE
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT '2', 'part', NULL, (CAST(COUNT(*) FILTER (WHERE regexp_matches(p_brand, '^Brand#[0-9]+$')) AS DOUBLE) / COUNT(*) * 100) / 100, NULL, TRUE FROM part
    UNION ALL
    SELECT '2', 'orders', NULL, NULL, COUNT(l_orderkey) = COUNT(*), COUNT(l_orderkey) = COUNT(*) FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    """,
)
def policy_quality_gate(spark, sf_dir):
    results = suite(GATE, catalog(spark, sf_dir, DOCUMENT_LABELS))
    rules = governance.QUALITY_RULES
    policies = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("tenant_id"), F.lit(True).alias("active"),
        *[F.lit(v).alias(k) for k, v in rules.items()],
    )
    return governance.quality_gate(results, policies)


EMAIL_SQL = governance.EMAIL_PATTERN


@query(
    "policy_mask",
    rf"""SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '***@***', 'g') AS text, '***' AS lang, sha256(source) AS source, NULL::BIGINT AS n_chars
         FROM documents""",
)
def policy_mask(spark, sf_dir):
    return governance.mask(
        table(spark, sf_dir, "documents"), {"text": "email", "source": "hash", "lang": "redact", "n_chars": "null"}
    )


@query(
    "policy_personal_data",
    rf"SELECT lang, COUNT(*) AS documents, COUNT(*) FILTER (WHERE regexp_matches(text, '{EMAIL_SQL}')) AS with_address FROM documents GROUP BY 1",
)
def policy_personal_data(spark, sf_dir):
    found = governance.contains_personal_data(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(found).alias("with_address")
    )


@query(
    "policy_retention",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-11-04' - INTERVAL 90 DAY",
)
def policy_retention(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return governance.within_retention(lines, "l_shipdate", 90, "2001-11-04 00:00:00")


@query(
    "policy_retention_expired",
    "SELECT l_returnflag, COUNT(*) AS expired FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-11-04' - INTERVAL 90 DAY GROUP BY 1",
)
def policy_retention_expired(spark, sf_dir):
    old = governance.past_retention(table(spark, sf_dir, "lineitem"), "l_shipdate", 90, "2001-11-04 00:00:00")
    return old.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("expired"))


def requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 120).alias("policy_id"),
        F.concat(F.lit("user-"), "user_id").alias("subject"), F.col("event_type").alias("action"),
        F.concat(F.lit("dataset/"), F.floor("value").cast("bigint")).alias("resource"),
        F.create_map(F.lit("day"), F.date_format("ts", "yyyy-MM-dd")).alias("context"),
    )


REQUESTS_SQL = """
    SELECT event_id AS request_id, user_id % 120 AS policy_id, 'user-' || user_id AS subject, event_type AS action,
           'dataset/' || CAST(FLOOR(value) AS BIGINT) AS resource, strftime(ts, '%Y-%m-%d') AS day FROM events"""


def policies(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("policy_id"), (F.col("s_acctbal") > 0).alias("active"))


@query(
    "access_decisions",
    f"""SELECT request_id, r.policy_id, COALESCE(s_acctbal > 0, FALSE) AS allowed,
               CASE WHEN s_suppkey IS NULL THEN 'policy not found' WHEN s_acctbal > 0 THEN 'policy evaluation passed'
                    ELSE 'policy is not active' END AS reason
        FROM ({REQUESTS_SQL}) r LEFT JOIN supplier ON r.policy_id = s_suppkey""",
)
def access_decisions(spark, sf_dir):
    return governance.access_decisions(requests(spark, sf_dir), policies(spark, sf_dir))


def access_rules(spark, sf_dir):
    key = F.col("s_suppkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    none = F.lit(None).cast("string")

    def rule(effect, actions, pattern, field=none, operator=none, value=none):
        return F.struct(
            F.lit(effect).alias("effect"), actions.alias("actions"), words(pattern).alias("resources"),
            field.alias("field"), operator.alias("operator"), value.alias("value"),
        )

    offered = F.array(
        F.when(key % 3 < 2, rule("allow", words("click", "view"), "dataset/*")),
        F.when(key % 2 == 0, rule("deny", words("*"), "dataset/1*")),
        F.when(key % 5 == 0, rule("allow", words("purchase"), "*", F.lit("day"), F.lit("matches"), F.lit("^2024-01-0"))),
        F.when(key % 7 == 0, rule("deny", words("error"), "*", F.lit("subject"), F.lit("contains"), F.lit("-1"))),
    )
    return table(spark, sf_dir, "supplier").select(key.alias("policy_id"), F.explode(F.array_compact(offered)).alias("r")).select("policy_id", "r.*")


@query(
    "access_decisions_with_rules",
    f"""
    WITH rules AS (
        SELECT s_suppkey AS policy_id, 'allow' AS effect, ['click', 'view'] AS actions, 'dataset/%' AS pattern, NULL AS field, NULL AS op, NULL AS v FROM supplier WHERE s_suppkey % 3 < 2
        UNION ALL SELECT s_suppkey, 'deny', ['*'], 'dataset/1%', NULL, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 0
        UNION ALL SELECT s_suppkey, 'allow', ['purchase'], '%', 'day', 'matches', '^2024-01-0' FROM supplier WHERE s_suppkey % 5 = 0
        UNION ALL SELECT s_suppkey, 'deny', ['error'], '%', 'subject', 'contains', '-1' FROM supplier WHERE s_suppkey % 7 = 0
    ),
    hits AS (
        SELECT request_id, effect,
               (list_contains(actions, '*') OR list_contains(actions, action)) AND resource LIKE pattern AND
               CASE WHEN op IS NULL THEN TRUE WHEN op = 'matches' THEN regexp_matches(day, v) ELSE contains(subject, v) END AS hit
        FROM ({REQUESTS_SQL}) JOIN rules USING (policy_id)
    ),
    tally AS (SELECT request_id, bool_or(hit AND effect = 'deny') AS d, bool_or(hit AND effect = 'allow') AS a FROM hits GROUP BY 1),
    v AS (
        SELECT r.request_id, r.policy_id,
               CASE WHEN s_suppkey IS NULL THEN 'policy not found' WHEN s_acctbal <= 0 THEN 'policy is not active'
                    WHEN t.d THEN 'denied by rule' WHEN NOT t.a THEN 'no rule matches' ELSE 'policy evaluation passed' END AS reason
        FROM ({REQUESTS_SQL}) r LEFT JOIN supplier ON r.policy_id = s_suppkey LEFT JOIN tally t ON r.request_id = t.request_id
    )
    SELECT request_id, policy_id, reason = 'policy evaluation passed' AS allowed, reason FROM v
    """,
)
def access_decisions_with_rules(spark, sf_dir):
    rules = access_rules(spark, sf_dir)
    return governance.access_decisions(requests(spark, sf_dir), policies(spark, sf_dir), rules)


@query(
    "policy_compliance_gaps",
    """
    WITH d AS (SELECT 'tenant-' || c_nationkey AS tenant_id, 'customer/' || c_custkey % 40 AS dataset FROM customer),
    f AS (SELECT 'tenant-' || o_custkey % 25 AS tenant_id, 'customer/' || o_custkey % 40 AS dataset FROM orders WHERE o_orderstatus = 'F'),
    a AS (SELECT 'tenant-' || user_id % 25 AS tenant_id, 'customer/' || user_id % 40 AS dataset FROM events WHERE event_type = 'view'),
    p AS (SELECT 'tenant-' || n_nationkey AS tenant_id, r_name AS framework, n_nationkey % 2 = 0 AS audit_required, n_nationkey % 3 > 0 AS lineage_tracking
          FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT tenant_id, framework, dataset, 'lineage' AS gap FROM d JOIN p USING (tenant_id)
    WHERE lineage_tracking AND (tenant_id, dataset) NOT IN (SELECT (tenant_id, dataset) FROM f)
    UNION ALL
    SELECT tenant_id, framework, dataset, 'audit' FROM d JOIN p USING (tenant_id)
    WHERE audit_required AND (tenant_id, dataset) NOT IN (SELECT (tenant_id, dataset) FROM a)
    """,
)
def policy_compliance_gaps(spark, sf_dir):
    # Forty names, so that tenants share them.
    named = lambda key: F.concat(F.lit("customer/"), F.col(key) % 40)
    tenant = lambda key: F.concat(F.lit("tenant-"), key)
    datasets = table(spark, sf_dir, "customer").select(tenant("c_nationkey").alias("tenant_id"), named("c_custkey").alias("dataset"))
    frameworks = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        tenant("n_nationkey").alias("tenant_id"), F.col("r_name").alias("framework"), F.lit(True).alias("active"),
        (F.col("n_nationkey") % 2 == 0).alias("audit_required"), (F.col("n_nationkey") % 3 > 0).alias("lineage_tracking"),
    )
    own = lambda key: (F.concat(F.lit("tenant-"), F.col(key) % 25).alias("tenant_id"), named(key).alias("dataset"))
    lineage = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(*own("o_custkey"))
    audits = table(spark, sf_dir, "events").where("event_type = 'view'").select(*own("user_id"))
    return governance.compliance_gaps(datasets, frameworks, lineage, audits)


# --------------------------------------------------------------------------- relationship tuples

TUPLES_SQL = """
    SELECT 'u' || (c_custkey + k) AS "user", ['owner', 'admin', 'editor', 'viewer'][k + 1] AS relation, 'tenant' AS object_type, CAST(c_custkey AS VARCHAR) AS object_id
    FROM customer CROSS JOIN (SELECT UNNEST([0, 1, 2, 3]) AS k)
    UNION ALL
    SELECT 'tenant:' || o_custkey, 'parent', ['policy', 'workflow', 'lineage'][o_orderkey % 3 + 1], CAST(o_orderkey AS VARCHAR) FROM orders
    UNION ALL
    SELECT 'u' || (o_custkey + 5), CASE WHEN o_orderkey % 2 = 0 THEN 'editor' ELSE 'owner' END, ['policy', 'workflow', 'lineage'][o_orderkey % 3 + 1],
           CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'"""
GRANTS_SQL = "(VALUES " + ", ".join(
    f"('{kind}', '{held}', '{given}')" for kind, held_by in access.GRANTS.items() for held, granted in held_by.items() for given in granted
) + ") g(object_type, held, relation)"
CARRY_SQL = "(VALUES " + ", ".join(f"('{kind}', '{r}')" for kind, rs in access.INHERITED.items() for r in rs) + ") i(object_type, held)"
EFFECTIVE_SQL = f"""
    WITH t AS ({TUPLES_SQL}),
    held AS (
        SELECT "user", relation, object_type, object_id FROM t WHERE relation <> 'parent'
        UNION SELECT m."user", m.relation, p.object_type, p.object_id FROM t p JOIN t m
            ON p.relation = 'parent' AND m.object_type = 'tenant' AND p."user" = 'tenant:' || m.object_id
            JOIN {CARRY_SQL} ON i.object_type = p.object_type AND i.held = m.relation
    )
    SELECT DISTINCT "user", g.relation, h.object_type, h.object_id FROM held h
    JOIN {GRANTS_SQL} ON g.object_type = h.object_type AND g.held = h.relation"""


def tuples(spark, sf_dir):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    members = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(words("owner", "admin", "editor", "viewer")).alias("k", "relation"))
    kind = F.get(words("policy", "workflow", "lineage"), (F.col("o_orderkey") % 3).cast("int"))
    orders = table(spark, sf_dir, "orders")
    member_rows = members.select(
        F.concat(F.lit("u"), F.col("c_custkey") + F.col("k")).alias("user"), "relation", F.lit("tenant").alias("object_type"),
        F.col("c_custkey").cast("string").alias("object_id"),
    )
    parent_rows = orders.select(
        F.concat(F.lit("tenant:"), "o_custkey").alias("user"), F.lit("parent").alias("relation"), kind.alias("object_type"),
        F.col("o_orderkey").cast("string").alias("object_id"),
    )
    direct_rows = orders.where("o_orderstatus = 'P'").select(
        F.concat(F.lit("u"), F.col("o_custkey") + 5).alias("user"),
        F.when(F.col("o_orderkey") % 2 == 0, "editor").otherwise("owner").alias("relation"), kind.alias("object_type"),
        F.col("o_orderkey").cast("string").alias("object_id"),
    )
    return member_rows.union(parent_rows).union(direct_rows)


@query("access_effective_permissions", EFFECTIVE_SQL)
def access_effective_permissions(spark, sf_dir):
    return access.effective_permissions(tuples(spark, sf_dir))


@query(
    "access_batch_check",
    f"""
    WITH e AS ({EFFECTIVE_SQL}),
    r AS (SELECT l_orderkey * 100 + l_linenumber AS request_id, 'u' || (o_custkey + l_linenumber) AS "user",
                 CASE WHEN l_returnflag = 'A' THEN 'viewer' ELSE 'editor' END AS relation,
                 ['policy', 'workflow', 'lineage'][o_orderkey % 3 + 1] AS object_type, CAST(o_orderkey AS VARCHAR) AS object_id
          FROM (SELECT l_orderkey, l_linenumber, MIN(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey)
    SELECT r.*, e."user" IS NOT NULL AS allowed FROM r LEFT JOIN e USING ("user", relation, object_type, object_id)
    """,
)
def access_batch_check(spark, sf_dir):
    kind = F.get(F.array(F.lit("policy"), F.lit("workflow"), F.lit("lineage")), (F.col("o_orderkey") % 3).cast("int"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "A").alias("any_a"))
    asked = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("request_id"),
        F.concat(F.lit("u"), F.col("o_custkey") + F.col("l_linenumber")).alias("user"),
        F.when(F.col("any_a"), "viewer").otherwise("editor").alias("relation"),
        kind.alias("object_type"), F.col("o_orderkey").cast("string").alias("object_id"),
    )
    return access.batch_check(asked, tuples(spark, sf_dir))


@query(
    "access_list_objects",
    f"""SELECT object_id FROM ({EFFECTIVE_SQL}) WHERE "user" = 'u7' AND relation = 'viewer' AND object_type = 'workflow'""",
)
def access_list_objects(spark, sf_dir):
    return access.list_objects(tuples(spark, sf_dir), "u7", "viewer", "workflow")


SETS_SQL = """SELECT "user", object_type, object_id, list_sort(list(relation)) AS relations FROM ({}) GROUP BY 1, 2, 3"""


@query(
    "access_sets_of_users",
    SETS_SQL.format(f"""SELECT * FROM ({EFFECTIVE_SQL}) WHERE "user" IN (SELECT 'u' || s_suppkey FROM supplier)"""),
)
def access_sets_of_users(spark, sf_dir):
    """What every supplier's user holds, on any object."""
    users = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("user"))
    return access.permission_sets(tuples(spark, sf_dir), users=users)


@query(
    "access_sets_of_objects",
    SETS_SQL.format(
        f"""SELECT * FROM ({EFFECTIVE_SQL}) e WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT'
            AND object_id = CAST(o_orderkey AS VARCHAR) AND object_type = ['policy', 'workflow', 'lineage'][o_orderkey % 3 + 1])"""
    ),
)
def access_sets_of_objects(spark, sf_dir):
    """Who holds what on the objects of urgent orders."""
    kind = F.get(F.array(F.lit("policy"), F.lit("workflow"), F.lit("lineage")), (F.col("o_orderkey") % 3).cast("int"))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    objects = urgent.select(kind.alias("object_type"), F.col("o_orderkey").cast("string").alias("object_id"))
    return access.permission_sets(tuples(spark, sf_dir), objects=objects)
