"""Lineage queries over events derived from the given tables.

Keys form the dataset graph: a region feeds its nations, a nation its customers, a customer
its orders. Runs are orders whose line items are the run's events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import lineage
from assayer.session import run_dir
from workload.base import query, table

EDGES_SQL = """
    SELECT 'region/' || n_regionkey AS source, 'nation/' || n_nationkey AS target FROM nation
    UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
    UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders"""


def _dataset(kind: str, key: str):
    return F.array(F.struct(F.lit(kind).alias("namespace"), F.col(key).cast("string").alias("name"), F.lit("{}").alias("facets")))


def load_events(spark, sf_dir) -> DataFrame:
    """One COMPLETE event per row: parent dataset in, own dataset out."""
    levels = [("nation", "region", "n_regionkey", "nation", "n_nationkey"),
              ("customer", "nation", "c_nationkey", "customer", "c_custkey"),
              ("orders", "customer", "o_custkey", "order", "o_orderkey")]
    parts = [
        table(spark, sf_dir, name).select(
            F.lit("complete").alias("event_type"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("event_time"),
            F.concat_ws("-", F.lit(name), F.col(key)).alias("run_id"),
            F.concat(F.lit("load_"), F.lit(name)).alias("job_name"),
            F.when(F.col(key) % 2 == 0, F.lit("warehouse")).alias("job_namespace"),
            _dataset(parent, parent_key).alias("inputs"),
            _dataset(own, key).alias("outputs"),
        )
        for name, parent, parent_key, own, key in levels
    ]
    return reduce(DataFrame.unionByName, parts)


def run_events(spark, sf_dir) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in lineage.EVENT_TYPES])
    return table(spark, sf_dir, "lineitem").select(
        F.get(kinds, (F.col("l_linenumber") - 1) % 5).alias("event_type"),
        F.col("l_shipdate").alias("event_time"),
        F.concat(F.lit("run-"), "l_orderkey").alias("run_id"),
        F.lit("ship").alias("job_name"),
        F.concat(F.lit("line "), F.col("l_linenumber"), F.lit(" \"late\"")).alias("message"),
    )


LOADED_SQL = """(SELECT 'nation' AS t, n_nationkey AS k, 'region' AS up, n_regionkey AS p FROM nation
    UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer
    UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey FROM orders)"""


@query(
    "lineage_events",
    f"""
    SELECT 'COMPLETE' AS event_type, t || '-' || k AS run_id, 'load_' || t AS job_name,
           CASE WHEN k % 2 = 0 THEN 'warehouse' ELSE 'default' END AS job_namespace, '{{}}' AS run_facets,
           'assayer' AS producer, 'https://openlineage.io/spec/2-0-2/OpenLineage.json' AS schema_url,
           up || '/' || p AS input FROM {LOADED_SQL}
    """,
)
def lineage_events(spark, sf_dir):
    rows = lineage.normalize_events(load_events(spark, sf_dir), "default")
    return rows.select(
        "event_type", "run_id", "job_name", "job_namespace", "run_facets", "producer", "schema_url",
        F.concat_ws("/", F.col("inputs")[0]["namespace"], F.col("inputs")[0]["name"]).alias("input"),
    )


@query(
    "lineage_fail_events",
    """
    SELECT 'FAIL' AS event_type, 'run-' || l_orderkey AS run_id, l_shipdate AS event_time,
           'line ' || l_linenumber || ' "late"' AS message, 'python' AS language
    FROM lineitem WHERE (l_linenumber - 1) % 5 = 3
    """,
)
def lineage_fail_events(spark, sf_dir):
    failures = run_events(spark, sf_dir).where("event_type = 'FAIL'").select("run_id", "job_name", "event_time", "message")
    events = lineage.fail_events(failures, "default")
    read = lambda path: F.get_json_object("run_facets", path)
    return events.select(
        "event_type", "run_id", "event_time",
        read("$.errorMessage.message").alias("message"), read("$.errorMessage.programmingLanguage").alias("language"),
    )


@query(
    "lineage_facets",
    f"""SELECT t || '-' || k AS run_id, CAST(p AS VARCHAR) AS owner,
              CASE WHEN k % 2 = 0 THEN 'warehouse' ELSE 'default' END AS job_namespace FROM {LOADED_SQL}""",
)
def lineage_facets(spark, sf_dir):
    events = lineage.normalize_events(load_events(spark, sf_dir), "default")
    marked = lineage.with_facet(events, "run_facets", "ownership", F.to_json(F.struct(F.col("inputs")[0]["name"].alias("owner"))))
    marked = lineage.with_facet(marked, "run_facets", "scope", F.to_json(F.struct(F.col("job_namespace").alias("name"))))
    read = lambda path: F.get_json_object("run_facets", path)
    return marked.select("run_id", read("$.ownership.owner").alias("owner"), read("$.scope.name").alias("job_namespace"))


@query("lineage_edges", f"""
    SELECT source, CASE WHEN CAST(split_part(target, '/', 2) AS BIGINT) % 2 = 0 THEN 'warehouse' ELSE 'default' END || '/load_' ||
           CASE split_part(target, '/', 1) WHEN 'order' THEN 'orders' ELSE split_part(target, '/', 1) END AS job, target FROM ({EDGES_SQL})""")
def lineage_edges(spark, sf_dir):
    return lineage.dataset_edges(lineage.normalize_events(load_events(spark, sf_dir), "default"))


@query(
    "lineage_run_states",
    """
    WITH e AS (SELECT 'run-' || l_orderkey AS run_id, (l_linenumber - 1) % 5 + 1 AS o, l_shipdate AS t FROM lineitem),
    r AS (SELECT run_id, MAX(t) AS last, MIN(t) FILTER (WHERE o = 1) AS started_at, MAX(t) FILTER (WHERE o > 2) AS ended_at
          FROM e GROUP BY 1),
    s AS (SELECT e.run_id, MAX(o) AS o FROM e JOIN r ON e.run_id = r.run_id AND e.t = r.last GROUP BY 1)
    SELECT r.run_id, ['START', 'RUNNING', 'COMPLETE', 'FAIL', 'ABORT'][s.o] AS state, started_at, ended_at,
           CAST(date_diff('microsecond', started_at, ended_at) AS DOUBLE) / 1e6 AS duration_seconds
    FROM r JOIN s ON r.run_id = s.run_id
    """,
)
def lineage_run_states(spark, sf_dir):
    return lineage.run_states(run_events(spark, sf_dir))


@query(
    "lineage_downstream",
    f"""
    WITH RECURSIVE edges AS ({EDGES_SQL}),
    reach(root, node, depth) AS (
        SELECT 'region/' || r_regionkey, 'region/' || r_regionkey, 0 FROM region
        UNION ALL SELECT root, target, depth + 1 FROM reach JOIN edges ON node = source
    )
    SELECT root, node, MIN(depth) AS depth FROM reach GROUP BY 1, 2
    """,
)
def lineage_downstream(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("node"))
    return lineage.downstream(lineage.dataset_edges(load_events(spark, sf_dir), distinct=False), roots)


@query(
    "lineage_upstream",
    f"""
    WITH RECURSIVE edges AS ({EDGES_SQL}),
    reach(root, node, depth) AS (
        SELECT 'order/' || o_orderkey, 'order/' || o_orderkey, 0 FROM orders WHERE o_totalprice > 450000
        UNION ALL SELECT root, source, depth + 1 FROM reach JOIN edges ON node = target
    )
    SELECT root, node, MIN(depth) AS depth FROM reach GROUP BY 1, 2
    """,
)
def lineage_upstream(spark, sf_dir):
    """Root causes of expensive orders, up to the regions."""
    roots = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.concat(F.lit("order/"), "o_orderkey").alias("node"))
    return lineage.upstream(lineage.dataset_edges(load_events(spark, sf_dir), distinct=False), roots)


REACH_SQL = f"""
    WITH RECURSIVE edges AS ({EDGES_SQL}),
    nodes AS (SELECT source AS node FROM edges UNION SELECT target FROM edges),
    reach(root, node, depth) AS (
        SELECT source, target, 1 FROM edges UNION ALL SELECT root, target, depth + 1 FROM reach JOIN edges ON node = source
    )"""


@query(
    "lineage_impact_counts",
    f"""{REACH_SQL}
    SELECT nodes.node AS root, COUNT(reach.node) AS reached, COALESCE(MAX(depth), 0) AS depth
    FROM nodes LEFT JOIN (SELECT DISTINCT * FROM reach) reach ON nodes.node = root GROUP BY 1
    """,
)
def lineage_impact_counts(spark, sf_dir):
    """How many datasets depend on each dataset, for all of them at once."""
    edges = lineage.dataset_edges(load_events(spark, sf_dir), distinct=False)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null")
    return lineage.reach_counts(edges, nodes)


@query("lineage_closure", f"{REACH_SQL} SELECT root, node, MIN(depth) AS depth FROM reach GROUP BY 1, 2")
def lineage_closure(spark, sf_dir):
    """The closure after its edges came in three batches, in no order of depth."""
    edges = lineage.dataset_edges(load_events(spark, sf_dir), distinct=False)
    closure = lineage.Closure(spark, run_dir(spark, "lineage_closure"))
    for number in range(3):
        closure.add(edges.where(F.crc32("target") % 3 == number))
    return closure.rows()


@query(
    "lineage_check_runs",
    """
    WITH r AS (SELECT 'check-' || user_id AS name, event_id, event_type = 'error' AS bad FROM events)
    SELECT 'START' AS event_type, event_id || ':' || name AS run_id, name AS job_name, 'quality/events' AS input FROM r
    UNION ALL SELECT CASE WHEN bad THEN 'FAIL' ELSE 'COMPLETE' END, event_id || ':' || name, name, 'quality/events' FROM r
    """,
)
def lineage_check_runs(spark, sf_dir):
    name = F.concat(F.lit("check-"), "user_id")
    results = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("run_id"), name.alias("check_id"), name.alias("check_name"), F.lit("events").alias("table_name"),
        F.when(F.col("event_type") == "error", "error").otherwise("passed").alias("status"),
        F.col("event_type").alias("error"), F.col("ts").alias("started_at"), F.col("ts").alias("executed_at"),
    )
    events = lineage.check_run_events(results, "quality")
    return events.select(
        "event_type", "run_id", "job_name",
        F.concat_ws("/", F.col("inputs")[0]["namespace"], F.col("inputs")[0]["name"]).alias("input"),
    )
