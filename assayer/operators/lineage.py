"""Lineage: event rows, dataset edges, run states, and impact over the edge graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.expressions import epoch_micros
from assayer.session import finished, removed, run_dir

EVENT_TYPES = ("START", "RUNNING", "COMPLETE", "FAIL", "ABORT")
TERMINAL_TYPES = ("COMPLETE", "FAIL", "ABORT")
PRODUCER = "assayer"
# Identifiers of the public event specification.
SCHEMA_URL = "https://openlineage.io/spec/2-0-2/OpenLineage.json"
ERROR_FACET_URL = "https://openlineage.io/spec/facets/1-0-0/ErrorMessageRunFacet.json"

# Hops after which the visited nodes are written as one table again, so that plans of deep graphs stay small.
COMPACT_EVERY = 16

DATASETS = "array<struct<namespace:string,name:string,facets:string>>"


def _or_default(df: DataFrame, name: str, default: Column) -> Column:
    if name not in df.columns:
        return default.alias(name)
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), default).alias(name)


def normalize_events(events: DataFrame, namespace: str, producer: str = PRODUCER) -> DataFrame:
    """Event rows with every field present and defaults filled in.

    Facets are JSON text. Unknown event types are dropped to NULL so that they can be found.
    """
    optional = lambda n, t: (F.col(n).cast(t) if n in events.columns else F.lit(None).cast(t)).alias(n)
    kind = F.upper("event_type")
    return events.select(
        F.when(kind.isin(*EVENT_TYPES), kind).alias("event_type"),
        F.col("event_time"),
        F.col("run_id").cast("string").alias("run_id"),
        _or_default(events, "run_facets", F.lit("{}")),
        _or_default(events, "job_namespace", F.lit(namespace)),
        F.col("job_name"),
        _or_default(events, "job_facets", F.lit("{}")),
        optional("inputs", DATASETS),
        optional("outputs", DATASETS),
        _or_default(events, "producer", F.lit(producer)),
        _or_default(events, "schema_url", F.lit(SCHEMA_URL)),
    )


def with_facet(events: DataFrame, column: str, name: str, facet: Column) -> DataFrame:
    """Add one facet (a JSON text) to the run or job facets of every event."""
    current = F.from_json(F.col(column), "map<string,string>")
    added = F.map_concat(
        F.map_filter(F.coalesce(current, F.create_map().cast("map<string,string>")), lambda k, _: k != name),
        F.create_map(F.lit(name), facet),
    )
    entries = F.transform(
        F.map_entries(added), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])
    )
    return events.withColumn(column, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))


def error_facet(message: Column, producer: str = PRODUCER) -> Column:
    """Run facets of a failed run, as JSON text."""
    facet = F.struct(
        F.lit(producer).alias("_producer"),
        F.lit(ERROR_FACET_URL).alias("_schemaURL"),
        message.alias("message"),
        F.lit("python").alias("programmingLanguage"),
    )
    return F.to_json(F.struct(facet.alias("errorMessage")))


def fail_events(failures: DataFrame, namespace: str) -> DataFrame:
    """FAIL events from rows with run_id, job_name, event_time and message."""
    events = failures.withColumn("event_type", F.lit("FAIL")).withColumn("run_facets", error_facet(F.col("message")))
    return normalize_events(events, namespace)


def check_run_events(results: DataFrame, namespace: str) -> DataFrame:
    """A START and a closing event for every check result, with the checked table as input.

    Results carry run_id, check_name, table_name, status, error, started_at and executed_at.
    """
    table = F.array(
        F.struct(F.lit(namespace).alias("namespace"), F.col("table_name").alias("name"), F.lit("{}").alias("facets"))
    )
    failed = F.col("status") == "error"
    run = F.concat_ws(":", F.col("run_id"), F.col("check_id"))
    # Both events come from one pass over the results.
    pair = F.array(
        F.struct(F.lit("START").alias("event_type"), F.col("started_at").alias("event_time"), F.lit("{}").alias("run_facets")),
        F.struct(
            F.when(failed, F.lit("FAIL")).otherwise(F.lit("COMPLETE")).alias("event_type"),
            F.col("executed_at").alias("event_time"),
            F.when(failed, error_facet(F.col("error"))).otherwise(F.lit("{}")).alias("run_facets"),
        ),
    )
    events = results.select(F.explode(pair).alias("e"), run.alias("run_id"), F.col("check_name").alias("job_name"), table.alias("inputs"))
    return normalize_events(events.select("e.*", "run_id", "job_name", "inputs"), namespace)


def dataset_edges(events: DataFrame, distinct: bool = True) -> DataFrame:
    """(source dataset, job, target dataset) triples. A job without inputs has a NULL source.

    ``downstream`` and ``upstream`` make edges distinct themselves; ``distinct=False`` saves one shuffle there.
    """
    pairs = events.select(
        "job_namespace", "job_name", F.explode_outer("inputs").alias("i"), "outputs"
    ).select("job_namespace", "job_name", "i", F.explode("outputs").alias("o"))
    edges = pairs.select(
        F.when(F.col("i").isNotNull(), node("i.namespace", "i.name")).alias("source"),
        node("job_namespace", "job_name").alias("job"),
        node("o.namespace", "o.name").alias("target"),
    )
    return edges.distinct() if distinct else edges


def node(namespace: str, name: str) -> Column:
    """A dataset or job as one text. Slashes and backslashes inside the namespace, which is often a URI,
    are escaped, so that two different pairs never become one node."""
    return F.concat_ws("/", F.regexp_replace(F.col(namespace), r"([/\\])", r"\\$1"), F.col(name))


def run_states(events: DataFrame) -> DataFrame:
    """Latest event type, start, end and duration of every run.

    Time and event type are packed into one number, later types winning at the same
    instant, so that all aggregates are numeric and stay in hash aggregation.
    """
    kinds = F.array(F.lit(None).cast("string"), *[F.lit(k) for k in EVENT_TYPES])
    code = F.lit(0)
    for position, kind in enumerate(EVENT_TYPES, start=1):
        code = F.when(F.col("event_type") == kind, F.lit(position)).otherwise(code)
    micros = epoch_micros(F.col("event_time"), events.schema["event_time"].dataType)
    ended = F.col("event_type").isin(*TERMINAL_TYPES)
    runs = events.groupBy("run_id").agg(
        F.max(micros * 8 + code).alias("_last"),
        F.min(F.when(F.col("event_type") == "START", F.col("event_time"))).alias("started_at"),
        F.max(F.when(ended, F.col("event_time"))).alias("ended_at"),
    )
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("ended_at")).cast("double") / 1e6
    return runs.select(
        "run_id",
        F.get(kinds, F.pmod(F.col("_last"), F.lit(8)).cast("int")).alias("state"),
        "started_at",
        "ended_at",
        seconds.alias("duration_seconds"),
    )


def downstream(edges: DataFrame, roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """Everything reachable from the roots along (source, target) edges, with its least depth."""
    return _reach(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), roots, max_depth)


def upstream(edges: DataFrame, roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """Everything the roots depend on, with its least depth."""
    return _reach(edges.select(F.col("target").alias("a"), F.col("source").alias("b")), roots, max_depth)


#: Roots of one word of a bit set.
ROOTS_PER_WORD = 64


def reach_counts(edges: DataFrame, roots: DataFrame, max_depth: int = 0) -> DataFrame:
    """How many nodes every root reaches along (source, target), itself left out: rows (root, reached, depth), depth the greatest.

    A breadth-first search from all roots at once. Roots are numbered, and a node carries the roots that
    have reached it as words of ROOTS_PER_WORD bits, so a step moves and merges (``bit_or``) 64 roots as
    one value: rows are (node, word), a 64th of (root, node) pairs where roots share what they reach.
    Cycles end, because only bits that are new to a node go on. Hops are written like those of
    ``downstream``.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    once = _written(pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edges")
    degrees = _written(once.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("out")), "degrees")
    # An edge knows how many edges leave its target: leaves are not joined, and the size of the next hop is known before it runs.
    known = _written(once.join(degrees, F.col("b") == F.col("node"), "left").select("a", "b", F.coalesce("out", F.lit(0)).alias("out")), "edges")
    every = _written(roots.select("node").distinct(), "roots")
    # Most nodes of a graph are often leaves: only roots with an edge get a number.
    places = _numbered(every.join(degrees, "node", "left_semi"))
    bit = F.expr(f"shiftleft(1L, cast(number % {ROOTS_PER_WORD} as int))")
    start = places.join(degrees, "node").select("node", F.floor(F.col("number") / ROOTS_PER_WORD).alias("word"), bit.alias("bits"), "out")
    frontier = _written(start, "frontier")
    seen, reached, stages, depth, held = frontier, None, [once, degrees, known, every, places, frontier], 0, 0
    while max_depth <= 0 or depth < max_depth:
        size = frontier.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("out"), F.lit(0)).alias("next")).first()
        if not size.next:
            break
        depth, held = depth + 1, held + size.rows
        none = F.lit(0).cast("bigint")
        arriving = frontier.where("out > 0").select("node", "word", "bits").join(known, F.col("node") == F.col("a"))
        arriving = arriving.select(F.col("b").alias("node"), "word", F.col("bits").alias("now"), none.alias("before"), "out")
        both = arriving.unionByName(seen.select("node", "word", none.alias("now"), F.col("bits").alias("before"), "out"))
        fresh = F.bit_or("now").bitwiseAND(F.bitwise_not(F.bit_or("before")))
        met = both.repartition(_tasks(size.next + held), "node", "word").groupBy("node", "word").agg(fresh.alias("bits"), F.max("out").alias("out"))
        frontier = _written(met.where("bits <> 0"), "frontier")
        gained = frontier.select("node", "word", "bits", F.lit(depth).alias("depth"))
        reached = gained if reached is None else reached.unionByName(gained)
        seen = seen.unionByName(frontier)
        stages.append(frontier)
        if depth % COMPACT_EVERY == 0:
            spread = seen.repartition(_tasks(held + size.next), "node", "word")
            seen = _written(spread.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"), F.max("out").alias("out")), "seen")
            stages.append(seen)
    counted = places.select("node", "number")
    if reached is None:
        counted = counted.withColumns({"reached": F.lit(None).cast("bigint"), "depth": F.lit(None).cast("int")})
    else:
        total = _per_root(reached).groupBy("number").agg(F.sum("n").alias("reached"), F.max("depth").alias("depth"))
        counted = counted.join(total, "number", "left")
    # Roots without an edge, mostly leaves, have no number: joined by it they would meet in one task.
    zero = every.select("node", F.lit(0).cast("bigint").alias("reached"), F.lit(0).alias("depth"))
    both = zero.unionByName(counted.select("node", "reached", "depth")).repartition(_tasks(every.count()), "node")
    whole = _written(both.groupBy(F.col("node").alias("root")).agg(F.max("reached").alias("reached"), F.max("depth").alias("depth")), "reach")
    _drop(spark, stages)
    return whole


def _per_root(reached: DataFrame) -> DataFrame:
    """Nodes by root and hop. Bits are counted within tasks before anything is shuffled."""
    at = [F.sum(F.getbit("bits", F.lit(k)).cast("bigint")).alias(f"b{k}") for k in range(ROOTS_PER_WORD)]
    wide = reached.groupBy("word", "depth").agg(*at)
    each = F.posexplode(F.array(*[F.col(f"b{k}") for k in range(ROOTS_PER_WORD)])).alias("k", "n")
    return wide.select("word", "depth", each).where("n > 0").select((F.col("word") * ROOTS_PER_WORD + F.col("k")).alias("number"), "n", "depth")


def _numbered(nodes: DataFrame) -> DataFrame:
    """Nodes numbered from 0 without gaps: places within partitions, after the counts of the partitions before."""
    rows = _written(nodes.select("node", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")), "numbered")
    sizes = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return _written(rows.join(before, "p").select("node", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("number")), "numbered")


def _drop(spark: SparkSession, stages: list[DataFrame]) -> None:
    for stage in stages:
        for path in {name.rsplit("/", 1)[0] for name in stage.inputFiles()}:
            removed(spark, path)


class Closure:
    """Everything that reaches everything, kept as tables while edges are added.

    Rows are (root, node, depth) for all nodes with edges, depth at least 1 and least. A path that is new
    leads to the source of a new edge, over it, and on by stored rows alone. So a batch is closed over the
    sources of its edges only (semi-naive, path lengths double), which leaves out all leaves, and the stored
    rows are read a fixed number of times, however many rounds that takes. Each batch is a version of its own
    folder; readers follow the newest complete one.
    """

    ROWS = "root string, node string, depth int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        return sorted(int(n.split("-")[1]) for n in finished(self.spark, self.path))

    def rows(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.ROWS)
        return self.spark.read.schema(self.ROWS).parquet(f"{self.path}/version-{versions[-1]}")

    def add(self, edges: DataFrame) -> None:
        """Extend the closure by edges (source, target)."""
        whole = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull())
        single = whole.select(F.col("source").alias("root"), F.col("target").alias("node"), F.lit(1).alias("depth")).distinct()
        known, versions = self.rows(), self._versions()
        fresh = _written(single.join(known.where("depth = 1"), ["root", "node"], "left_anti"), "closure-new")
        stages = [fresh]
        if not versions or not fresh.isEmpty():
            sources = _written(fresh.select(F.col("root").alias("node")).distinct(), "closure-sources")
            # Stored paths that end at a source, then new edges and what follows them up to the next source.
            before = _written(known.join(sources, "node", "left_semi").select("root", "node", "depth"), "closure-before")
            direct = fresh.join(sources, "node", "left_semi").select("root", "node", "depth")
            hops = _written(_least(direct.unionByName(_joined(fresh, before))), "closure-hops")
            stages += [sources, before, hops]
            inner = _closed(hops, stages)
            start = sources.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
            to_source = _least(start.unionByName(before).unionByName(inner).unionByName(_joined(before, inner)))
            over = _least(_joined(to_source, fresh))
            if versions:
                stay = fresh.select("node").distinct().select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
                over = _joined(over, known.unionByName(stay))
            found = _written(over, "closure-found")
            stages.append(found)
            every = known.unionByName(found) if versions else found
            merged = every.repartition(_tasks(every.count()), "root", "node") if versions else every
            number = versions[-1] + 1 if versions else 0
            (_least(merged) if versions else merged).write.mode("overwrite").parquet(f"{self.path}/version-{number}")
            for old in versions[:-1]:  # the last one may still be read
                removed(self.spark, f"{self.path}/version-{old}")
        _drop(self.spark, stages)


#: Rows one task aggregates at most, unless a key has more.
ROWS_PER_TASK = 500_000


def _tasks(rows: int) -> int:
    """Partitions for an aggregation of that many rows: what a task holds does not grow with the input."""
    return max(1, -(-rows // ROWS_PER_TASK))


def _least(paths: DataFrame) -> DataFrame:
    return paths.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def _closed(hops: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """The closure of rows (root, node, depth) under composition. Only rows that are new or got shorter take part in the
    next round, as the left or the right half of a path."""
    known = fresh = hops
    while not fresh.isEmpty():
        paths = _joined(fresh, known) if fresh is known else _joined(fresh, known).unionByName(_joined(known, fresh))
        fresh = _written(_shorter(_least(paths), known), "closure-new")
        stages.append(fresh)
        if not fresh.isEmpty():
            known = _written(_least(known.unionByName(fresh)), "closure")
            stages.append(known)
    return known


def _joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Paths of one row of each."""
    left = first.select("root", F.col("node").alias("via"), F.col("depth").alias("steps"))
    right = second.select(F.col("root").alias("via"), "node", "depth")
    return left.join(right, "via").select("root", "node", (F.col("steps") + F.col("depth")).alias("depth"))


def _shorter(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` that are not known, or only with a greater depth."""
    old = known.select("root", "node", F.col("depth").alias("_depth"))
    return found.join(old, ["root", "node"], "left").where(F.col("_depth").isNull() | (F.col("depth") < F.col("_depth"))).drop("_depth")


def _written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of an iteration by writing it to the shared folder."""
    spark = df.sparkSession
    path = run_dir(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first frontier by frontier; rows are (root, node, depth).

    Every hop is written to the shared folder, so a lost executor costs one hop, and the
    written sizes let Spark choose between broadcasting a small frontier and a shuffle join
    with skew splitting. Nodes already reached are left out, so cycles end.
    """
    # Projected before the one distinct: several jobs between two datasets are one edge here.
    known = _written(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edges")
    first = roots.select(F.col("node").alias("root"), F.col("node"), F.lit(0).alias("depth")).distinct()
    frontier = _written(first, "frontier")
    reached = frontier
    stages = [known, frontier]
    depth = 0
    while not frontier.isEmpty() and (max_depth <= 0 or depth < max_depth):
        depth += 1
        steps = frontier.join(known, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        fresh = steps.join(reached, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = _written(fresh, "frontier")
        reached = reached.unionByName(frontier)
        stages.append(frontier)
        if depth % COMPACT_EVERY == 0:  # shapes the plan only
            reached = _written(reached, "reached")
            stages.append(reached)
    whole = _written(reached, "reached")
    _drop(whole.sparkSession, stages)
    return whole
