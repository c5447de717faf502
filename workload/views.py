"""View queries: every part of a view definition."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans.views import problems
from assayer.specs import FilterDef, JoinDef, OrderByDef, SelectDef, ViewDefinition, ViewSpec
from workload.base import catalog, query, view_query

view_query(
    "view_raw_sql",
    ViewDefinition(sql="""
        SELECT c_mktsegment AS segment, COUNT(*) AS orders, MAX(o_totalprice) AS top_price
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""),
    """SELECT c_mktsegment AS segment, COUNT(*) AS orders, MAX(o_totalprice) AS top_price
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
)
view_query("view_all_columns", ViewDefinition(base_table="customer"), "SELECT * FROM customer")
view_query(
    "view_projection",
    ViewDefinition(
        base_table="lineitem",
        columns=[
            SelectDef("l_orderkey"),
            SelectDef("line", source_column="l_linenumber"),
            SelectDef("net", expression="l_extendedprice * (1 - l_discount)"),
            SelectDef("flag", source_column="l_returnflag", alias="return_flag"),
            SelectDef("x", expression="l_quantity + 1", alias="quantity_plus"),
        ],
    ),
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
              l_returnflag AS return_flag, l_quantity + 1 AS quantity_plus FROM lineitem""",
)


def filtered(name: str, base: str, columns: list[str], filters: list[FilterDef], where: str) -> None:
    view_query(
        name,
        ViewDefinition(base_table=base, columns=[SelectDef(c) for c in columns], filters=filters),
        f"SELECT {', '.join(columns)} FROM {base} WHERE {where}",
    )


ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
filtered("view_filter_eq", "orders", ORDER, [FilterDef("o_orderstatus", "eq", "F")], "o_orderstatus = 'F'")
filtered("view_filter_ne", "orders", ORDER, [FilterDef("o_orderstatus", "ne", "F")], "o_orderstatus <> 'F'")
filtered("view_filter_lt", "lineitem", ["l_orderkey", "l_quantity"], [FilterDef("l_quantity", "lt", 3)], "l_quantity < 3")
filtered("view_filter_lte", "lineitem", ["l_orderkey", "l_quantity"], [FilterDef("l_quantity", "lte", 3)], "l_quantity <= 3")
filtered(
    "view_filter_gt_time", "orders", ["o_orderkey", "o_orderdate"],
    [FilterDef("o_orderdate", "gt", "1999-12-31 00:00:00")], "o_orderdate > TIMESTAMP '1999-12-31 00:00:00'",
)
filtered("view_filter_gte", "part", ["p_partkey", "p_size"], [FilterDef("p_size", "gte", 30.5)], "p_size >= 30.5")
filtered(
    "view_filter_in", "part", ["p_partkey", "p_size"],
    [FilterDef("p_size", "in", values=["1", 2, 3])], "p_size IN (1, 2, 3)",
)
filtered(
    "view_filter_not_in", "orders", ORDER,
    [FilterDef("o_orderstatus", "not_in", values=["F", "O"])], "o_orderstatus NOT IN ('F', 'O')",
)
filtered(
    "view_filter_not_in_null", "orders", ORDER,
    [FilterDef("o_orderstatus", "not_in", values=["F", None])], "o_orderstatus NOT IN ('F', NULL)",
)
filtered(
    "view_filter_like", "customer", ["c_custkey", "c_name"],
    [FilterDef("c_name", "like", "%00_5%")], "c_name LIKE '%00_5%'",
)
filtered(
    "view_filter_precedence", "orders", ORDER,
    [
        FilterDef("o_orderstatus", "eq", "F"),
        FilterDef("o_orderstatus", "eq", "O", logical_op="OR"),
        FilterDef("o_totalprice", "gt", 400000, logical_op="AND"),
    ],
    "o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 400000",
)

LABELS_LEFT = dict(
    base_table="documents d",
    joins=[JoinDef("labels l", "left", ("d.doc_id", "l.doc_id"))],
    columns=[SelectDef("d.doc_id"), SelectDef("lang"), SelectDef("quality")],
)
view_query(
    "view_filter_is_null",
    ViewDefinition(**LABELS_LEFT, filters=[FilterDef("quality", "is_null")]),
    "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL",
)
view_query(
    "view_filter_is_not_null",
    ViewDefinition(**LABELS_LEFT, filters=[FilterDef("l.quality", "is_not_null"), FilterDef("lang", "eq", "en")]),
    """SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE quality IS NOT NULL AND lang = 'en'""",
)
view_query(
    "view_join_inner",
    ViewDefinition(
        base_table="orders o",
        joins=[JoinDef("customer c", "inner", ("o.o_custkey", "c.c_custkey")), JoinDef("nation n", "inner", ("c.c_nationkey", "n.n_nationkey"))],
        columns=[SelectDef("o.o_orderkey"), SelectDef("o.o_totalprice"), SelectDef("c.c_name", alias="customer_name"), SelectDef("n_name")],
    ),
    """SELECT o_orderkey, o_totalprice, c_name AS customer_name, n_name
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
view_query(
    "view_join_left",
    ViewDefinition(**LABELS_LEFT),
    "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
view_query(
    "view_join_right",
    ViewDefinition(
        base_table="events e",
        joins=[JoinDef("customer c", "right", ("e.user_id", "c.c_custkey"))],
        columns=[SelectDef("c.c_custkey"), SelectDef("e.event_id"), SelectDef("e.event_type")],
    ),
    "SELECT c_custkey, event_id, event_type FROM events RIGHT JOIN customer ON user_id = c_custkey",
)
view_query(
    "view_join_full",
    ViewDefinition(
        base_table="part p",
        joins=[JoinDef("supplier s", "full", ("p.p_partkey", "s.s_suppkey"))],
        columns=[SelectDef("p_partkey"), SelectDef("p_name"), SelectDef("s_suppkey"), SelectDef("s_name")],
    ),
    "SELECT p_partkey, p_name, s_suppkey, s_name FROM part FULL JOIN supplier ON p_partkey = s_suppkey",
)
view_query(
    "view_join_two_keys",
    ViewDefinition(
        base_table="customer c",
        joins=[JoinDef("supplier s", "inner", ("c.c_nationkey", "s.s_nationkey", "c.c_custkey", "s.s_suppkey"))],
        columns=[SelectDef("c_custkey"), SelectDef("s_name")],
    ),
    "SELECT c_custkey, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey",
)
view_query(
    "view_join_cross",
    ViewDefinition(
        base_table="customer",
        joins=[JoinDef("region", "cross")],
        columns=[SelectDef("r_name"), SelectDef("customers", expression="COUNT(*)"), SelectDef("top", expression="MAX(c_acctbal)")],
        group_by=["r_name"],
    ),
    "SELECT r_name, COUNT(*) AS customers, MAX(c_acctbal) AS top FROM customer CROSS JOIN region GROUP BY r_name",
)
view_query(
    "view_join_theta",
    ViewDefinition(
        base_table="orders",
        joins=[JoinDef("customer", "inner", on_condition="o_custkey = c_custkey AND o_totalprice > c_acctbal * 50")],
        columns=[SelectDef("o_orderkey"), SelectDef("c_name"), SelectDef("c_acctbal")],
    ),
    "SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 50",
)
view_query(
    "view_join_skewed",
    ViewDefinition(
        base_table="lineitem l",
        joins=[JoinDef("supplier s", "left", ("l.l_suppkey", "s.s_suppkey"), skew_share=0.01)],
        columns=[SelectDef("l.l_orderkey"), SelectDef("l.l_linenumber"), SelectDef("l.l_partkey"), SelectDef("s.s_name")],
    ),
    "SELECT l_orderkey, l_linenumber, l_partkey, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
)
view_query(
    "view_group_by",
    ViewDefinition(
        base_table="orders",
        columns=[
            SelectDef("o_custkey"),
            SelectDef("order_count", expression="COUNT(*)"),
            SelectDef("last_order", expression="MAX(o_orderdate)"),
            SelectDef("spent", expression="ROUND(SUM(o_totalprice), 2)"),
        ],
        group_by=["o_custkey"],
    ),
    """SELECT o_custkey, COUNT(*) AS order_count, MAX(o_orderdate) AS last_order, ROUND(SUM(o_totalprice), 2) AS spent
       FROM orders GROUP BY o_custkey""",
)
view_query(
    "view_group_by_day",
    ViewDefinition(
        base_table="orders",
        columns=[
            SelectDef("day", expression="CAST(date_trunc('day', o_orderdate) AS DATE)"),
            SelectDef("order_count", expression="COUNT(*)"),
            SelectDef("buyers", expression="COUNT(DISTINCT o_custkey)"),
        ],
        group_by=["day"],
    ),
    """SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS day, COUNT(*) AS order_count,
              COUNT(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1""",
)
view_query(
    "view_order_limit",
    ViewDefinition(
        base_table="orders",
        columns=[SelectDef("o_orderkey"), SelectDef("o_totalprice")],
        order_by=[OrderByDef("o_totalprice", "desc"), OrderByDef("o_orderkey", "asc")],
        limit=25,
    ),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
view_query(
    "view_order_nulls",
    ViewDefinition(**LABELS_LEFT, order_by=[OrderByDef("quality", "desc"), OrderByDef("d.doc_id")], limit=50),
    """SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       ORDER BY quality DESC NULLS FIRST, d.doc_id LIMIT 50""",
)

CUSTOMER_NATIONS = ViewSpec(
    "customer_nations", ViewDefinition(base_table="customer", columns=[SelectDef("c_nationkey", alias="nationkey")])
)
SUPPLIER_NATIONS = ViewSpec(
    "supplier_nations", ViewDefinition(base_table="supplier", columns=[SelectDef("s_nationkey", alias="nationkey")])
)
view_query(
    "view_union",
    ViewDefinition(union_tables=["customer_nations", "supplier_nations"]),
    "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
    (CUSTOMER_NATIONS, SUPPLIER_NATIONS),
)
view_query(
    "view_union_all",
    ViewDefinition(union_tables=["customer_nations", "supplier_nations"], union_all=True),
    "SELECT c_nationkey AS nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    (CUSTOMER_NATIONS, SUPPLIER_NATIONS),
)
BIG_ORDERS = ViewSpec(
    "big_orders", ViewDefinition(base_table="orders", filters=[FilterDef("o_totalprice", "gt", 300000)])
)
view_query(
    "view_over_view",
    ViewDefinition(sql="SELECT o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS least FROM big_orders GROUP BY o_orderstatus"),
    "SELECT o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS least FROM orders WHERE o_totalprice > 300000 GROUP BY o_orderstatus",
    (BIG_ORDERS,),
)
SEGMENT_TOTALS = ViewSpec(
    "segment_totals",
    ViewDefinition(
        base_table="orders",
        joins=[JoinDef("customer", "inner", ("o_custkey", "c_custkey"))],
        columns=[SelectDef("c_mktsegment"), SelectDef("o_orderstatus"), SelectDef("n", expression="COUNT(*)")],
        group_by=["c_mktsegment", "o_orderstatus"],
        order_by=[OrderByDef("c_mktsegment"), OrderByDef("o_orderstatus")],
    ),
)


@query(
    "view_query_capped",
    """SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
       GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 7""",
)
def view_query_capped(spark, sf_dir):
    return catalog(spark, sf_dir, SEGMENT_TOTALS).query_view("segment_totals", 7)


@query(
    "view_row_count",
    "SELECT COUNT(*) AS row_count FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL",
)
def view_row_count(spark, sf_dir):
    unlabeled = ViewSpec("unlabeled", ViewDefinition(**LABELS_LEFT, filters=[FilterDef("quality", "is_null")]))
    return catalog(spark, sf_dir, unlabeled).count_view("unlabeled")


@query(
    "view_documented_examples",
    """SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS date, COUNT(*) AS order_count, ROUND(SUM(o_totalprice), 2) AS revenue
       FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL '30 days' GROUP BY 1""",
)
def view_documented_examples(spark, sf_dir):
    recent = ViewSpec(
        "recent_revenue",
        ViewDefinition(sql="""
            SELECT date_trunc('day', o_orderdate) AS date, COUNT(*) AS order_count, ROUND(SUM(o_totalprice), 2) AS revenue
            FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '2001-08-01 00:00:00' - INTERVAL '30' DAY
            GROUP BY 1"""),
    )
    rows = catalog(spark, sf_dir, recent).query_view("recent_revenue")
    return rows.withColumn("date", F.col("date").cast("timestamp_ntz"))

#: Drafts of views: the first three can be kept, the others have something wrong.
DRAFTS = {
    "open_orders": ViewDefinition(base_table="orders", filters=[FilterDef("o_orderstatus", "eq", "O")]),
    "labelled": ViewDefinition(base_table="documents d", joins=[JoinDef("labels l", "inner", ("d.doc_id", "l.doc_id"))], columns=[SelectDef("d.doc_id")]),
    "places": ViewDefinition(union_tables=["region", "region"]),
    "nothing": ViewDefinition(),
    "bare_group": ViewDefinition(base_table="orders", group_by=["o_orderstatus"]),
    "odd_parts": ViewDefinition(
        base_table="orders",
        joins=[JoinDef("customer", "sideways", ("o_custkey", "c_custkey")), JoinDef("nation", "inner", ())],
        filters=[FilterDef("", "eq", 1), FilterDef("o_orderkey", "in"), FilterDef("o_orderkey", "resembles", 2)],
    ),
}


@query(
    "view_validation",
    """SELECT 'open_orders' AS name, 0 AS problem_count, '' AS problems, COUNT(*) AS row_count FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT 'labelled', 0, '', COUNT(*) FROM documents d JOIN labels l ON d.doc_id = l.doc_id
       UNION ALL SELECT 'places', 0, '', COUNT(*) FROM (SELECT * FROM region UNION SELECT * FROM region)
       UNION ALL SELECT 'nothing', 1, 'the view reads nothing: give it sql, base_table or union_tables', NULL
       UNION ALL SELECT 'bare_group', 1, 'a grouped view must list its columns', NULL
       UNION ALL SELECT 'odd_parts', 5, 'join 1 cannot be of type ''sideways''; join 2 matches on nothing; only a cross join may; '
           || 'filter 1 names no column; filter 2 lists no values; filter 3 cannot compare by ''resembles''', NULL""",
)
def view_validation(spark, sf_dir):
    """Every draft with all that is wrong with it; those that can be kept with their rows."""
    tables = catalog(spark, sf_dir, *[ViewSpec(name, draft) for name, draft in DRAFTS.items()])
    refused = [(name, len(found), "; ".join(found), None) for name, draft in DRAFTS.items() if (found := problems(draft))]
    out = spark.createDataFrame(refused, "name string, problem_count int, problems string, row_count bigint")
    for name in [n for n in DRAFTS if n not in {r[0] for r in refused}]:
        out = out.union(tables.count_view(name).select(F.lit(name), F.lit(0), F.lit(""), "row_count"))
    return out
