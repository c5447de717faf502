"""Check queries: every check type over whole tables, single and fused."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans.suite import select_checks, suite
from assayer.operators import distribution, volume
from assayer.operators.checks import measure
from assayer.session import run_dir
from assayer.specs import ColumnInfo, SelectDef, Threshold, ViewDefinition, ViewSpec
from workload.base import DOCUMENT_LABELS, catalog, check, query, spec, table


def share(hit: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN CAST({hit} AS DOUBLE) / CAST({total} AS DOUBLE) * 100 ELSE 0 END"


def match_sql(source: str, condition: str, hit: str, miss: str, pct: str, limit: float = 100) -> str:
    return f"""
        WITH m AS (
            SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {condition}) AS h FROM {source}
        )
        SELECT n AS total_count, h AS {hit}, n - h AS {miss}, {share('h', 'n')} AS {pct},
               CASE WHEN {share('h', 'n')} < {limit} THEN 'failed' ELSE 'passed' END AS status
        FROM m"""


check(
    "check_row_count",
    spec("rows", "row_count", "lineitem", min_rows=1000),
    """SELECT COUNT(*) AS row_count, CASE WHEN COUNT(*) < 1000 THEN 'failed' ELSE 'passed' END AS status FROM lineitem""",
)
check(
    "check_row_count_max",
    spec("rows", "row_count", "orders", min_rows=10, max_rows=1000),
    """SELECT COUNT(*) AS row_count,
              CASE WHEN COUNT(*) < 10 OR COUNT(*) > 1000 THEN 'failed' ELSE 'passed' END AS status FROM orders""",
)


def null_sql(source: str, column: str, fails: str) -> str:
    return f"""
        WITH m AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {column} IS NULL) AS z FROM {source})
        SELECT n AS total_count, z AS null_count, {share('z', 'n')} AS null_percentage,
               CASE WHEN {fails} THEN 'failed' ELSE 'passed' END AS status
        FROM m"""


LABELED = "(SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
check(
    "check_null_on_view",
    spec("nulls", "null_check", view_id="document_labels", column="quality", max_null_percentage=50.0),
    null_sql(LABELED, "quality", f"{share('z', 'n')} > 50"),
    (DOCUMENT_LABELS,),
)
check(
    "check_null_count_limit",
    spec("nulls", "null_check", view_id="document_labels", column="quality", max_null_count=10),
    null_sql(LABELED, "quality", "z > 10"),
    (DOCUMENT_LABELS,),
)
check(
    "check_null_clean_column",
    spec("nulls", "null_check", "lineitem", "l_shipdate", max_null_percentage=0.0, strict_zero=True),
    null_sql("lineitem", "l_shipdate", "z > 0"),
)


def unique_sql(source: str, keys: list[str], limit: float = 100, null_fails: bool = False) -> str:
    key = keys[0] if len(keys) == 1 else f"({', '.join(keys)})"
    full = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    also = " OR k > 0" if null_fails else ""
    return f"""
        WITH m AS (
            SELECT COUNT(*) AS n, COUNT(DISTINCT {key}) FILTER (WHERE {full}) AS u,
                   COUNT(*) FILTER (WHERE NOT ({full})) AS k
            FROM {source}
        )
        SELECT n AS total_count, u AS unique_count, k AS null_key_count, n - u AS duplicate_count,
               {share('u', 'n')} AS uniqueness_percentage,
               CASE WHEN {share('u', 'n')} < {limit}{also} THEN 'failed' ELSE 'passed' END AS status
        FROM m"""


check("check_uniqueness_key", spec("u", "uniqueness", "orders", "o_orderkey"), unique_sql("orders", ["o_orderkey"]))
check("check_uniqueness_text", spec("u", "uniqueness", "documents", "text"), unique_sql("documents", ["text"]))
check(
    "check_uniqueness_threshold",
    spec("u", "uniqueness", "documents", "text", threshold=Threshold(value=90.0)),
    unique_sql("documents", ["text"], 90),
)
check(
    "check_uniqueness_columns",
    spec("u", "uniqueness", "lineitem", unique_columns=["l_orderkey", "l_linenumber"]),
    unique_sql("lineitem", ["l_orderkey", "l_linenumber"]),
)
check(
    "check_uniqueness_nullable_columns",
    spec("u", "uniqueness", view_id="document_labels", unique_columns=["lang", "quality"], allow_nulls=False, threshold=Threshold(value=0.1)),
    unique_sql(
        "(SELECT d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
        ["lang", "quality"],
        0.1,
        True,
    ),
    (DOCUMENT_LABELS,),
)

check(
    "check_freshness",
    spec("f", "freshness", "events", timestamp_column="ts", as_of="2024-02-01 00:00:00", max_age_hours=24.0),
    """
    WITH m AS (SELECT MAX(ts) AS t FROM events),
    a AS (SELECT t, CAST(date_diff('microsecond', t, TIMESTAMP '2024-02-01 00:00:00') AS DOUBLE) / 3.6e9 AS h FROM m)
    SELECT t AS latest_timestamp, h AS age_hours, CASE WHEN h > 24 THEN 'failed' ELSE 'passed' END AS status FROM a
    """,
)

check(
    "check_custom_sql_value",
    spec("q", "custom_sql", custom_sql="SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'", expected_value="4933"),
    """SELECT CAST(COUNT(*) AS VARCHAR) AS actual_text, TRUE AS row_found, CAST(1 AS BIGINT) AS row_count,
              CASE WHEN COUNT(*) = 4933 THEN 'passed' ELSE 'failed' END AS status
       FROM orders WHERE o_orderstatus = 'F'""",
)
check(
    "check_custom_sql_rows",
    spec("q", "custom_sql", count_rows=True, custom_sql="""
        SELECT MIN(l_orderkey) FROM lineitem GROUP BY l_returnflag HAVING SUM(l_quantity) > 100000 ORDER BY 1"""),
    """
    WITH g AS (SELECT MIN(l_orderkey) AS k FROM lineitem GROUP BY l_returnflag HAVING SUM(l_quantity) > 100000)
    SELECT CAST(MIN(k) AS VARCHAR) AS actual_text, COUNT(*) > 0 AS row_found, COUNT(*) AS row_count,
           CASE WHEN COUNT(*) > 0 THEN 'passed' ELSE 'failed' END AS status FROM g
    """,
)
check(
    "check_custom_sql_no_rows",
    spec("q", "custom_sql", custom_sql="SELECT l_orderkey FROM lineitem WHERE l_quantity < 0"),
    """SELECT CAST(MIN(l_orderkey) AS VARCHAR) AS actual_text, COUNT(*) > 0 AS row_found,
              CAST(COUNT(*) > 0 AS BIGINT) AS row_count, CASE WHEN COUNT(*) > 0 THEN 'passed' ELSE 'failed' END AS status
       FROM lineitem WHERE l_quantity < 0""",
)
check(
    "check_custom_sql_on_view",
    spec("q", "custom_sql", view_id="document_labels", custom_sql="SELECT COUNT(*) FROM _view WHERE quality IS NULL",
         threshold=Threshold(operator="lte", value=100.0)),
    """
    WITH m AS (SELECT COUNT(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL)
    SELECT CAST(n AS VARCHAR) AS actual_text, TRUE AS row_found, CAST(1 AS BIGINT) AS row_count,
           CASE WHEN n <= 100 THEN 'passed' ELSE 'failed' END AS status FROM m
    """,
    (DOCUMENT_LABELS,),
)


def value_sql(expr: str, source: str, fails: str = "FALSE") -> str:
    return f"""
        WITH m AS (SELECT CAST({expr} AS DOUBLE) AS v FROM {source})
        SELECT v AS actual_value, CASE WHEN {fails} THEN 'failed' ELSE 'passed' END AS status FROM m"""


check(
    "check_min_value",
    spec("v", "min_value", "lineitem", "l_quantity", expected_min=1.0),
    value_sql("MIN(l_quantity)", "lineitem", "ABS(v - 1) > 0"),
)
check(
    "check_max_value",
    spec("v", "max_value", "lineitem", "l_quantity", expected_max=49.0, tolerance=0.5),
    value_sql("MAX(l_quantity)", "lineitem", "ABS(v - 49) > 0.5"),
)
check(
    "check_sum_value",
    spec("v", "sum_value", "lineitem", "l_quantity"),
    value_sql("SUM(l_quantity)", "lineitem"),
)
check(
    "check_sum_value_operator",
    spec("v", "sum_value", "lineitem", "l_quantity", threshold=Threshold(operator="between", min_value=1.0, max_value=1000.0)),
    value_sql("SUM(l_quantity)", "lineitem", "NOT (v BETWEEN 1 AND 1000)"),
)


def rounded(name: str, one, sql: str, digits: int = 6):
    """Averages depend on the order of addition, so their last digits are rounded away."""

    @query(name, sql)
    def run(spark, sf_dir):
        tables = catalog(spark, sf_dir)
        flat = measure(one, tables.resolve(one.table), tables.context())
        return flat.withColumn("actual_value", F.round("actual_value", digits))


rounded(
    "check_mean_value",
    spec("v", "mean_value", "lineitem", "l_quantity", expected_mean=25.5, threshold=Threshold(value=0.2)),
    """WITH m AS (SELECT AVG(l_quantity) AS v FROM lineitem)
       SELECT ROUND(v, 6) AS actual_value, CASE WHEN ABS(v - 25.5) > 0.2 THEN 'failed' ELSE 'passed' END AS status FROM m""",
)
rounded(
    "check_std_dev",
    spec("v", "std_dev", "lineitem", "l_quantity", threshold=Threshold(operator="lt", value=14.0)),
    """WITH m AS (SELECT STDDEV_SAMP(l_quantity) AS v FROM lineitem)
       SELECT ROUND(v, 6) AS actual_value, CASE WHEN v < 14 THEN 'passed' ELSE 'failed' END AS status FROM m""",
)

MATCH = ("match_count", "non_match_count", "match_percentage")
check(
    "check_regex_name",
    spec("r", "regex", "customer", "c_name", pattern="^Customer#0000000[0-9]{2}$"),
    match_sql("customer", "regexp_matches(c_name, '^Customer#0000000[0-9]{2}$')", *MATCH),
)
check(
    "check_regex_url",
    spec("r", "regex", "pages", "url", pattern="^https://", threshold=Threshold(value=60.0)),
    match_sql("pages", "regexp_matches(url, '^https://')", *MATCH, 60),
)
check(
    "check_regex_unanchored",
    spec("r", "regex", "documents", "text", pattern="[0-9]{3}", threshold=Threshold(value=10.0), warn_threshold=99.0),
    match_sql("documents", "regexp_matches(text, '[0-9]{3}')", *MATCH, 10).replace(
        "ELSE 'passed' END AS status", f"WHEN {share('h', 'n')} < 99 THEN 'warning' ELSE 'passed' END AS status"
    ),
)
check(
    "check_format_url",
    spec("r", "format", "pages", "url", format="url"),
    match_sql("pages", r"regexp_matches(url, '^https?://[^/?#\s]+[^\s]*$')", *MATCH),
)
check(
    "check_format_date",
    spec("r", "format", "orders", "o_orderdate", format="datetime"),
    match_sql("orders", "TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NOT NULL", *MATCH),
)
check(
    "check_range",
    spec("r", "range", "customer", "c_acctbal", expected_min=0.0, expected_max=9999.0, threshold=Threshold(value=90.0)),
    match_sql("customer", "c_acctbal BETWEEN 0 AND 9999", "in_range_count", "out_of_range_count", "in_range_percentage", 90),
)
check(
    "check_range_open_end",
    spec("r", "range", "lineitem", "l_discount", expected_max=0.05),
    match_sql("lineitem", "l_discount BETWEEN 0 AND 0.05", "in_range_count", "out_of_range_count", "in_range_percentage"),
)
VALID = ("valid_count", "invalid_count", "valid_percentage")
check(
    "check_set_text",
    spec("s", "set_membership", "orders", "o_orderstatus", allowed_values=["F", "O"]),
    match_sql("orders", "o_orderstatus IN ('F', 'O')", *VALID),
)
check(
    "check_set_number",
    spec("s", "set_membership", "part", "p_size", allowed_values=["1", "2", "3"], threshold=Threshold(value=5.0)),
    match_sql("part", "p_size IN (1, 2, 3)", *VALID, 5),
)
check(
    "check_set_nulls",
    spec("s", "set_membership", view_id="document_labels", column="quality", allowed_values=["0", "1"]),
    match_sql(LABELED, "quality IN (0, 1)", *VALID),
    (DOCUMENT_LABELS,),
)


def reference_sql(child: str, key: str, ref: str, ref_key: str, child_mode: bool = False) -> str:
    if child_mode:
        counts = f"SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE {key} IN (SELECT {ref_key} FROM {ref})) AS h FROM {child}"
    else:
        counts = f"SELECT COUNT(*) AS n, COUNT(r.{ref_key}) AS h FROM {child} t LEFT JOIN {ref} r ON t.{key} = r.{ref_key}"
    return f"""
        WITH m AS ({counts})
        SELECT n AS total_count, h AS matched_count, n - h AS orphan_count, {share('h', 'n')} AS integrity_percentage,
               CASE WHEN {share('h', 'n')} < 100 THEN 'failed' ELSE 'passed' END AS status
        FROM m"""


check(
    "check_referential_orphans",
    spec("i", "referential_integrity", "documents", "doc_id", reference_table="labels", reference_column="doc_id"),
    reference_sql("documents", "doc_id", "labels", "doc_id"),
)
check(
    "check_referential_clean",
    spec("i", "referential_integrity", "lineitem", "l_partkey", reference_table="part", reference_column="p_partkey"),
    reference_sql("lineitem", "l_partkey", "part", "p_partkey"),
)
check(
    "check_referential_fan_out",
    spec("i", "referential_integrity", "orders", "o_orderkey", reference_table="lineitem", reference_column="l_orderkey"),
    reference_sql("orders", "o_orderkey", "lineitem", "l_orderkey"),
)
check(
    "check_referential_child_mode",
    spec("i", "referential_integrity", "orders", "o_orderkey", reference_table="lineitem", reference_column="l_orderkey",
         count_mode="child"),
    reference_sql("orders", "o_orderkey", "lineitem", "l_orderkey", True),
)

check(
    "check_schema_match",
    spec("m", "schema_match", "orders", expected_schema=[
        ColumnInfo("o_orderkey", "bigint"), ColumnInfo("o_custkey", "int"), ColumnInfo("o_comment"), ColumnInfo("o_orderstatus")]),
    """
    WITH a AS (SELECT column_name AS c FROM information_schema.columns WHERE table_name = 'orders')
    SELECT COUNT(*) AS column_count, 'o_comment' AS missing_columns,
           STRING_AGG(c, ',' ORDER BY c) FILTER (WHERE c NOT IN ('o_orderkey', 'o_custkey', 'o_orderstatus')) AS extra_columns,
           'o_custkey: expected int, got bigint' AS type_mismatches, 'failed' AS status FROM a
    """,
)
check(
    "check_column_count",
    spec("c", "column_count", "lineitem", expected_columns=11),
    """SELECT COUNT(*) AS column_count, CASE WHEN COUNT(*) = 11 THEN 'passed' ELSE 'failed' END AS status
       FROM information_schema.columns WHERE table_name = 'lineitem'""",
)
check(
    "check_column_type",
    spec("t", "column_type", "events", "user_id", expected_schema=[ColumnInfo("user_id", "int8")]),
    """SELECT lower(data_type) AS actual_type, 'bigint' AS expected_type,
              CASE WHEN lower(data_type) = 'bigint' THEN 'passed' ELSE 'failed' END AS status
       FROM information_schema.columns WHERE table_name = 'events' AND column_name = 'user_id'""",
)
check(
    "check_volume",
    spec("w", "volume", "events", expected_volume=9000, volume_tolerance=10.0),
    """SELECT COUNT(*) AS row_count, ABS(CAST(COUNT(*) AS DOUBLE) - 9000) / 9000 * 100 AS deviation_percentage,
              CASE WHEN ABS(COUNT(*) - 9000) > 900 THEN 'failed' ELSE 'passed' END AS status FROM events""",
)
check(
    "check_distribution",
    spec("d", "distribution", "events", "event_type", tolerance=0.05, expected_distribution={
        "click": 0.25, "view": 0.25, "purchase": 0.25, "error": 0.25}),
    """
    WITH c AS (SELECT event_type AS v, COUNT(*) AS n FROM events GROUP BY 1),
    t AS (SELECT CAST(SUM(n) AS BIGINT) AS n, COUNT(*) AS k FROM c),
    e(v, s) AS (VALUES ('click', 0.25::DOUBLE), ('view', 0.25), ('purchase', 0.25), ('error', 0.25)),
    g AS (SELECT MAX(ABS(COALESCE(CAST(c.n AS DOUBLE), 0) / t.n - COALESCE(e.s, 0))) AS gap
          FROM t CROSS JOIN (c FULL JOIN e ON c.v = e.v))
    SELECT t.n AS total_count, t.k AS value_count, gap AS max_deviation,
           CASE WHEN gap > 0.05 THEN 'failed' ELSE 'passed' END AS status FROM t CROSS JOIN g
    """,
)


@query(
    "distribution_report",
    """
    WITH c AS (SELECT lang AS v, COUNT(*) AS n FROM documents GROUP BY 1),
    e(v, s) AS (VALUES ('en', 0.7::DOUBLE), ('de', 0.2), ('xx', 0.1))
    SELECT COALESCE(c.v, e.v) AS value, COALESCE(c.n, 0) AS row_count,
           COALESCE(CAST(c.n AS DOUBLE), 0) / CAST((SELECT SUM(n) FROM c) AS DOUBLE) AS actual_share, e.s AS expected_share,
           ABS(COALESCE(CAST(c.n AS DOUBLE), 0) / CAST((SELECT SUM(n) FROM c) AS DOUBLE) - COALESCE(e.s, 0)) AS deviation
    FROM c FULL JOIN e ON c.v = e.v
    """,
)
def distribution_report(spark, sf_dir):
    return distribution.shares(table(spark, sf_dir, "documents"), "lang", {"en": 0.7, "de": 0.2, "xx": 0.1})


@query(
    "volume_by_day",
    """
    WITH c AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, COUNT(*) AS n FROM events GROUP BY 1),
    b AS (SELECT bucket, COALESCE(n, 0) AS n FROM (SELECT UNNEST(generate_series(MIN(bucket), MAX(bucket), INTERVAL 1 DAY)) AS bucket FROM c) LEFT JOIN c USING (bucket))
    SELECT bucket, n AS row_count, ABS(CAST(n AS DOUBLE) - 330) / 330 * 100 AS deviation_percentage,
           CASE WHEN ABS(CAST(n AS DOUBLE) - 330) > 16.5 THEN 'failed' ELSE 'passed' END AS status
    FROM b
    """,
)
def volume_by_day(spark, sf_dir):
    return volume.by_bucket(table(spark, sf_dir, "events"), "ts", "day", 330, 5.0)


SUITE = [
    spec("rows", "row_count", "lineitem", min_rows=1000, severity="high"),
    spec("quantity_min", "min_value", "lineitem", "l_quantity", expected_min=1.0),
    spec("quantity_max", "max_value", "lineitem", "l_quantity", expected_max=50.0),
    spec("discount_range", "range", "lineitem", "l_discount", expected_max=0.1),
    spec("flag_values", "set_membership", "lineitem", "l_returnflag", allowed_values=["A", "N"]),
    spec("flag_pattern", "regex", "lineitem", "l_linestatus", pattern="^[FO]$"),
    spec("ship_nulls", "null_check", "lineitem", "l_shipdate", max_null_percentage=1.0),
    spec("line_key", "uniqueness", "lineitem", unique_columns=["l_orderkey", "l_linenumber"], severity="critical"),
    spec("part_fk", "referential_integrity", "lineitem", "l_partkey", reference_table="part", reference_column="p_partkey"),
    spec("order_fk", "referential_integrity", "lineitem", "l_orderkey", reference_table="orders", reference_column="o_orderkey"),
    spec("customer_names", "regex", "customer", "c_name", pattern="^Customer#"),
    spec("balances", "range", "customer", "c_acctbal", expected_max=9999.0),
    spec("quality_nulls", "null_check", view_id="document_labels", column="quality", max_null_percentage=50.0),
    spec("texts", "uniqueness", "documents", "text"),
    spec("bad_pattern", "regex", "customer", "c_name", pattern="("),
    spec("switched_off", "row_count", "orders", min_rows=1, active=False),
]


def suite_sql() -> str:
    def row(id: str, actual: str, status: str, source: str) -> str:
        return f"SELECT '{id}' AS check_id, CAST({actual} AS DOUBLE) AS actual_value, {status} AS status FROM {source}"

    def low(hit: str, n: str = "COUNT(*)") -> tuple[str, str]:
        pct = share(hit, n)
        return pct, f"CASE WHEN {pct} < 100 THEN 'failed' ELSE 'passed' END"

    kept = "COUNT(*) FILTER (WHERE {})"
    rows = [
        row("rows", "COUNT(*)", "CASE WHEN COUNT(*) < 1000 THEN 'failed' ELSE 'passed' END", "lineitem"),
        row("quantity_min", "MIN(l_quantity)", "CASE WHEN MIN(l_quantity) <> 1 THEN 'failed' ELSE 'passed' END", "lineitem"),
        row("quantity_max", "MAX(l_quantity)", "CASE WHEN MAX(l_quantity) <> 50 THEN 'failed' ELSE 'passed' END", "lineitem"),
        row("discount_range", *low(kept.format("l_discount BETWEEN 0 AND 0.1")), "lineitem"),
        row("flag_values", *low(kept.format("l_returnflag IN ('A', 'N')")), "lineitem"),
        row("flag_pattern", *low(kept.format("regexp_matches(l_linestatus, '^[FO]$')")), "lineitem"),
        row("ship_nulls", share(kept.format("l_shipdate IS NULL"), "COUNT(*)"), "'passed'", "lineitem"),
        row("line_key", *low("COUNT(DISTINCT (l_orderkey, l_linenumber))"), "lineitem"),
        row("part_fk", *low("COUNT(p_partkey)"), "lineitem LEFT JOIN part ON l_partkey = p_partkey"),
        row("order_fk", *low("COUNT(o_orderkey)"), "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"),
        row("customer_names", *low(kept.format("regexp_matches(c_name, '^Customer#')")), "customer"),
        row("balances", *low(kept.format("c_acctbal BETWEEN 0 AND 9999")), "customer"),
        row("quality_nulls", share(kept.format("quality IS NULL"), "COUNT(*)"),
            f"CASE WHEN {share(kept.format('quality IS NULL'), 'COUNT(*)')} > 50 THEN 'failed' ELSE 'passed' END", LABELED),
        row("texts", *low("COUNT(DISTINCT text)"), "documents"),
        "SELECT 'bad_pattern', NULL, 'error'",
        "SELECT 'switched_off', NULL, 'skipped'",
    ]
    return "\nUNION ALL ".join(rows)


@query("suite_fused", suite_sql())
def suite_fused(spark, sf_dir):
    return suite(SUITE, catalog(spark, sf_dir, DOCUMENT_LABELS)).select("check_id", "actual_value", "status")


@query("suite_sequential", suite_sql())
def suite_sequential(spark, sf_dir):
    """The same checks planned one by one, each with a scan of its own: the yardstick for the fused suite."""
    tables = catalog(spark, sf_dir, DOCUMENT_LABELS)
    out = None
    for one in SUITE:
        rows = suite([one], tables).select("check_id", "actual_value", "status")
        out = rows if out is None else out.union(rows)
    return out


SPENDERS = ViewSpec(
    "spenders",
    ViewDefinition(
        base_table="orders o",
        joins=[{"table": "customer c", "type": "inner", "on_columns": ["o.o_custkey", "c.c_custkey"]}],
        columns=[SelectDef("o_orderkey"), SelectDef("o_totalprice"), SelectDef("o_orderstatus"), SelectDef("c_nationkey"), SelectDef("c_acctbal"), SelectDef("o_custkey")],
    ),
)
BIG_SPENDERS = ViewSpec("big_spenders", ViewDefinition(base_table="spenders", filters=[{"column": "o_totalprice", "operator": "gt", "value": 200000}]))
SHARED = [
    spec("rows", "row_count", "spenders"),
    spec("prices", "max_value", "spenders", "o_totalprice"),
    spec("keys", "uniqueness", "spenders", "o_orderkey"),
    spec("nations", "referential_integrity", "spenders", "c_nationkey", reference_table="nation", reference_column="n_nationkey"),
    spec("customers", "uniqueness", "big_spenders", "o_custkey"),
    spec("paid", "custom_sql", custom_sql="SELECT COUNT(*) FROM spenders WHERE o_orderstatus = 'F'"),
]


@query(
    "suite_shared_view",
    """
    WITH s AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT 'rows' AS check_id, COUNT(*)::DOUBLE AS actual_value, NULL AS actual_text FROM s UNION ALL SELECT 'prices', MAX(o_totalprice), NULL FROM s
    UNION ALL SELECT 'keys', COUNT(DISTINCT o_orderkey)::DOUBLE / COUNT(*) * 100, NULL FROM s
    UNION ALL SELECT 'nations', COUNT(n_nationkey)::DOUBLE / COUNT(*) * 100, NULL FROM s LEFT JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'customers', COUNT(DISTINCT o_custkey)::DOUBLE / COUNT(*) * 100, NULL FROM s WHERE o_totalprice > 200000
    UNION ALL SELECT 'paid', COUNT(*)::DOUBLE, COUNT(*)::VARCHAR FROM s WHERE o_orderstatus = 'F'
    """,
)
def suite_shared_view(spark, sf_dir):
    """Five parts over one join view: the join runs once."""
    from assayer.plans.suite import execute

    rows = execute(SHARED, catalog(spark, sf_dir, SPENDERS, BIG_SPENDERS), run_dir(spark, "suite_shared_view"), "run")
    return rows.select("check_id", "actual_value", "actual_text")


@query(
    "suite_empty_table",
    """
    SELECT 'rows' AS check_id, 0::DOUBLE AS actual_value, 'passed' AS status WHERE (SELECT COUNT(*) FROM lineitem WHERE l_quantity < 0) = 0
    UNION ALL SELECT 'nulls', 0, 'passed' UNION ALL SELECT 'unique', 0, 'failed' UNION ALL SELECT 'regex', 0, 'failed'
    UNION ALL SELECT 'range', 0, 'failed' UNION ALL SELECT 'set', 0, 'failed' UNION ALL SELECT 'ref', 0, 'failed'
    UNION ALL SELECT 'min', NULL, 'error' UNION ALL SELECT 'sum', NULL, 'passed' UNION ALL SELECT 'fresh', NULL, 'error'
    """,
)
def suite_empty_table(spark, sf_dir):
    from assayer.specs import ViewDefinition, ViewSpec

    empty = ViewSpec(
        "no_lines",
        ViewDefinition(base_table="lineitem", filters=[{"column": "l_quantity", "operator": "lt", "value": 0}]),
    )
    specs = [
        spec("rows", "row_count", "no_lines"),
        spec("nulls", "null_check", "no_lines", "l_tax", max_null_percentage=1.0),
        spec("unique", "uniqueness", "no_lines", "l_orderkey"),
        spec("regex", "regex", "no_lines", "l_returnflag", pattern="."),
        spec("range", "range", "no_lines", "l_tax", expected_max=1.0),
        spec("set", "set_membership", "no_lines", "l_returnflag", allowed_values=["A"]),
        spec("ref", "referential_integrity", "no_lines", "l_partkey", reference_table="part", reference_column="p_partkey"),
        spec("min", "min_value", "no_lines", "l_tax", expected_min=1.0),
        spec("sum", "sum_value", "no_lines", "l_tax"),
        spec("fresh", "freshness", "no_lines", timestamp_column="l_shipdate", max_age_hours=1.0),
    ]
    return suite(specs, catalog(spark, sf_dir, empty)).select("check_id", "actual_value", "status")


# --------------------------------------------------------------------------- cases the plain tables do not have

GAPPY_EVENTS = ViewSpec("gappy_events", ViewDefinition(sql="SELECT * FROM events WHERE date_trunc('DAY', ts) <> TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
check(
    "check_volume_daily",
    spec("v", "volume", view_id="gappy_events", timestamp_column="ts", grain="day", expected_volume=330, volume_tolerance=50.0),
    """
    WITH g AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events WHERE date_trunc('day', ts) <> TIMESTAMP '2024-01-10'),
    c AS (SELECT d, COUNT(*) AS n FROM g GROUP BY 1),
    b AS (SELECT d, COALESCE(n, 0) AS n FROM (SELECT UNNEST(generate_series(MIN(d), MAX(d), INTERVAL 1 DAY)) AS d FROM c) LEFT JOIN c USING (d))
    SELECT CAST(SUM(n) AS BIGINT) AS row_count, COUNT(*) AS bucket_count, COUNT(*) FILTER (WHERE ABS(n - 330) > 165) AS failed_buckets,
           COUNT(*) FILTER (WHERE n = 0) AS empty_buckets, MAX(ABS(CAST(n AS DOUBLE) - 330) / 330 * 100) AS deviation_percentage,
           CASE WHEN COUNT(*) FILTER (WHERE ABS(n - 330) > 165) > 0 THEN 'failed' ELSE 'passed' END AS status FROM b
    """,
    views=(GAPPY_EVENTS,),
)
check(
    "check_custom_sql_count",
    spec("n", "custom_sql", custom_sql="SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 ORDER BY l_orderkey DESC", expected_value="0"),
    """SELECT CAST(MAX(l_orderkey) AS VARCHAR) AS actual_text, COUNT(*) > 0 AS row_found, COUNT(*) AS row_count, 'failed' AS status
       FROM lineitem WHERE l_quantity > 10""",
)
# Prices as decimals, keys above what a double can tell apart.
EXACT = ViewSpec("exact", ViewDefinition(sql="SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS price, 9007199254740992 + o_orderkey AS big, o_orderdate FROM orders"))
_PRICED = "(SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS price, 9007199254740992 + o_orderkey AS big FROM orders)"
check(
    "check_range_big_keys",
    spec("r", "range", view_id="exact", column="big", expected_min=9007199254740992, expected_max=9007199254740993),
    match_sql(_PRICED, "big BETWEEN 9007199254740992 AND 9007199254740993", "in_range_count", "out_of_range_count", "in_range_percentage"),
    views=(EXACT,),
)
check(
    "check_set_decimal",
    spec("s", "set_membership", view_id="exact", column="price", allowed_values=["1000.005", "2000.00", "3e3"]),
    match_sql(_PRICED, "price IN (1000.005, 2000.00, 3000)", "valid_count", "invalid_count", "valid_percentage"),
    views=(EXACT,),
)
check(
    "check_sum_big_keys",
    spec("b", "sum_value", view_id="exact", column="big"),
    f"SELECT CAST(SUM(CAST(big AS DECIMAL(38,0))) AS DOUBLE) AS actual_value, 'passed' AS status FROM {_PRICED}",
    views=(EXACT,),
)


@query("suite_unknown_ids", """
    SELECT 'gone' AS check_id, 'error' AS status, 'check not found' AS error
    UNION ALL SELECT 'rows', CASE WHEN COUNT(*) < 1000 THEN 'failed' ELSE 'passed' END, NULL FROM lineitem""")
def suite_unknown_ids(spark, sf_dir):
    listed = select_checks(SUITE, check_ids=["gone", "rows"])
    return suite(listed, catalog(spark, sf_dir)).select("check_id", "status", "error")
