"""Lineage reachability, workflow replay against brute force, permissions, policies."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import access, governance, lineage, workflow
from assayer.specs import SpecError
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


# --------------------------------------------------------------------------- lineage


def edges(spark, *pairs):
    return spark.createDataFrame([(a, "job", b) for a, b in pairs], "source string, job string, target string")


def test_reach_is_cycle_safe_and_least_depth(spark):
    graph = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "y"), (None, "a"))
    roots = spark.createDataFrame([("a",), ("x",), ("a",)], "node string")
    assert rows(lineage.downstream(graph, roots)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("x", "x", 0), ("x", "y", 1)]
    assert rows(lineage.downstream(graph, roots, 1)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("x", "x", 0), ("x", "y", 1)]
    up = lineage.upstream(graph, spark.createDataFrame([("d",)], "node string"))
    assert rows(up) == [("d", "a", 2), ("d", "b", 2), ("d", "c", 1), ("d", "d", 0)]


def test_reach_matches_brute_force_on_a_hub(spark):
    rng = random.Random(3)
    pairs = {("hub", f"n{i}") for i in range(60)} | {(f"n{rng.randrange(60)}", f"m{rng.randrange(40)}") for _ in range(120)}
    known = {"hub": 0}
    frontier = ["hub"]
    for depth in itertools.count(1):
        frontier = sorted({b for a, b in pairs if a in frontier} - set(known))
        if not frontier:
            break
        known |= dict.fromkeys(frontier, depth)
    got = lineage.downstream(edges(spark, *pairs), spark.createDataFrame([("hub",)], "node string"))
    assert {r.node: r.depth for r in got.collect()} == known


def test_events_facets_edges_and_states(spark):
    events = spark.createDataFrame(
        [("start", T0, "r1", "load", [("db", "a")], None), ("COMPLETE", T0 + dt.timedelta(seconds=135), "r1", "load", [("db", "a")], [("db", "b"), ("db", "c")]),
         ("COMPLETE", T0, "r2", "seed", None, [("db", "a")]), ("WRONG", T0, "r3", "odd", None, None)],
        "event_type string, event_time timestamp, run_id string, job_name string, inputs array<struct<namespace:string,name:string>>, outputs array<struct<namespace:string,name:string>>",
    )
    lift = lambda c: F.transform(c, lambda d: F.struct(d["namespace"].alias("namespace"), d["name"].alias("name"), F.lit("{}").alias("facets")))
    normal = lineage.normalize_events(events.withColumns({"inputs": lift("inputs"), "outputs": lift("outputs")}), "ns")
    assert {r.event_type for r in normal.collect()} == {"START", "COMPLETE", None}
    assert {r.job_namespace for r in normal.collect()} == {"ns"}
    assert rows(lineage.dataset_edges(normal)) == [("db/a", "ns/load", "db/b"), ("db/a", "ns/load", "db/c"), (None, "ns/seed", "db/a")]
    states = {r.run_id: r for r in lineage.run_states(normal).collect()}
    assert states["r1"].state == "COMPLETE" and states["r1"].duration_seconds == 135.0
    assert states["r3"].state is None
    marked = lineage.with_facet(lineage.with_facet(normal, "run_facets", "a", F.lit('{"x":1}')), "run_facets", "a", F.lit('{"x":2}'))
    assert json.loads(marked.first().run_facets) == {"a": {"x": 2}}
    quoted = spark.range(1).select(lineage.error_facet(F.lit('it "broke"')).alias("f")).first().f
    assert json.loads(quoted)["errorMessage"]["message"] == 'it "broke"'


def test_check_runs_become_event_pairs(spark):
    results = spark.createDataFrame(
        [("run", "c1", "rows", "t", "passed", None, T0, T0), ("run", "c2", "sql", "t", "error", "boom", T0, T0)],
        "run_id string, check_id string, check_name string, table_name string, status string, error string, started_at timestamp, executed_at timestamp",
    )
    got = rows(lineage.check_run_events(results, "q"), "run_id", "event_type")
    assert got == [("run:c1", "COMPLETE"), ("run:c1", "START"), ("run:c2", "FAIL"), ("run:c2", "START")]


# --------------------------------------------------------------------------- workflow


def brute(flow, events):
    table = {(e, s): d for e, sources, d in flow.transitions for s in sources}
    state, accepted, refused = flow.initial, 0, []
    for event in events:
        if (event, state) in table:
            state, accepted = table[event, state], accepted + 1
        else:
            refused.append(event)
    return state, accepted, len(refused), refused[0] if refused else None


@pytest.mark.parametrize("flow", workflow.STANDARD, ids=lambda w: w.name)
@pytest.mark.parametrize("batch", [7, 10000])
def test_replay_equals_brute_force_with_a_hot_entity(spark, flow, batch):
    rng = random.Random(11)
    log, want = [], {}
    for entity, n in [("hot", 900), ("warm", 60)] + [(f"e{i}", rng.randrange(1, 9)) for i in range(40)]:
        picks = [rng.choice([*flow.events, "unheard"]) for _ in range(n)]
        want[entity] = brute(flow, picks)
        log += [(entity, e, T0 + dt.timedelta(seconds=i // 3), i) for i, e in enumerate(picks)]
    rng.shuffle(log)
    frame = spark.createDataFrame(log, "entity string, event string, ts timestamp_ntz, event_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.entity: (r.state, r.accepted, r.rejected, r.first_rejected) for r in workflow.replay(frame, flow, 9).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert got == want


def test_replay_input_and_transitions(spark):
    with pytest.raises(SpecError):
        workflow.replay(spark.range(1), workflow.APPROVAL)
    assert workflow.transition_table(spark).groupBy("workflow").count().collect()
    assert workflow.transition_table(spark).count() == 9 + 10 + 14
    current = spark.createDataFrame([("x", "under_review"), ("y", "approved")], "entity string, state string")
    assert rows(workflow.available_transitions(current, workflow.APPROVAL), "entity", "event") == [
        ("x", "approve"), ("x", "cancel"), ("x", "reject"), ("x", "request_changes")]
    asked = spark.createDataFrame([("x", "approve"), ("y", "approve"), ("new", "submit")], "entity string, event string")
    assert rows(workflow.can_transition(asked, current, workflow.APPROVAL), "entity", "allowed") == [("new", True), ("x", True), ("y", False)]


# --------------------------------------------------------------------------- access


@pytest.fixture
def tuples(spark):
    data = [
        ("ann", "owner", "tenant", "t1"), ("bob", "admin", "tenant", "t1"), ("cid", "viewer", "tenant", "t1"), ("dan", "editor", "policy", "p1"),
        ("tenant:t1", "parent", "policy", "p1"), ("tenant:t1", "parent", "lineage", "l1"), ("eve", "owner", "policy", "p2"),
    ]
    return spark.createDataFrame(data, "user string, relation string, object_type string, object_id string")


def test_effective_permissions(tuples):
    held = {tuple(r) for r in access.effective_permissions(tuples).collect()}
    assert {r for u, r, t, o in held if (u, t, o) == ("ann", "policy", "p1")} == {"owner", "editor", "viewer"}
    assert {r for u, r, t, o in held if (u, t, o) == ("ann", "lineage", "l1")} == {"owner", "viewer"}
    assert {r for u, r, t, o in held if (u, t) == ("bob", "tenant")} == {"admin", "member"}
    assert not [h for h in held if h[0] == "bob" and h[2] != "tenant"]
    assert {r for u, r, t, o in held if u == "dan"} == {"editor", "viewer"}


def test_batch_check_agrees_with_the_expansion(spark, tuples):
    held = {tuple(r) for r in access.effective_permissions(tuples).collect()}
    objects = [("policy", "p1"), ("policy", "p2"), ("lineage", "l1"), ("tenant", "t1"), ("workflow", "w1")]
    asked = [(i, u, r, t, o) for i, (u, r, (t, o)) in enumerate(itertools.product(
        ["ann", "bob", "cid", "dan", "eve", "zed"], ["owner", "admin", "editor", "viewer", "member"], objects))]
    frame = spark.createDataFrame(asked, "request_id long, user string, relation string, object_type string, object_id string")
    got = {r.request_id: r.allowed for r in access.batch_check(frame, tuples).collect()}
    assert got == {i: (u, r, t, o) in held for i, u, r, t, o in asked}
    assert rows(access.list_objects(tuples, "cid", "viewer", "policy")) == [("p1",)]


# --------------------------------------------------------------------------- policies


def test_masking(people):
    masked = governance.mask(people, {"name": "redact", "amount": "null"})
    assert masked.columns == people.columns and rows(masked, "name", "amount")[0] == ("***", None)
    text = people.sparkSession.createDataFrame([("write to a.b@x.org, or c@y.co.uk!", "s")], "t string, h string")
    got = governance.mask(text, {"t": "email", "h": "hash"}).first()
    assert got.t == "write to ***@***, or ***@***!" and len(got.h) == 64
    with pytest.raises(SpecError):
        governance.mask(people, {"nope": "hash"})
    with pytest.raises(SpecError):
        governance.mask(people, {"name": "rot13"})


def test_quality_gate(spark):
    results = spark.createDataFrame(
        [("t1", "good", "null_check", 4.0, "passed"), ("t1", "good", "regex", 99.0, "passed"), ("t1", "holes", "null_check", 6.0, "passed"),
         ("t1", "wrong", "range", 97.0, "passed"), ("t1", "orphans", "referential_integrity", 99.9, "failed")],
        "tenant_id string, table_name string, check_type string, actual_value double, status string",
    )
    rules = spark.createDataFrame([("t1", True, 0.95, 0.98, True)], "tenant_id string, active boolean, completeness_threshold double, accuracy_threshold double, consistency_checks boolean")
    assert rows(governance.quality_gate(results, rules), "dataset", "allowed") == [("good", True), ("holes", False), ("orphans", False), ("wrong", False)]


def test_access_decisions(spark):
    asked = spark.createDataFrame(
        [(1, "on", "ann", "read", "data/x_1", {}), (2, "off", "ann", "read", "data/x_1", {}), (3, "gone", "ann", "read", "data/x_1", {}),
         (4, "ruled", "ann", "read", "data/x_1", {"team": "red"}), (5, "ruled", "ann", "write", "data/x_1", {}), (6, "ruled", "ann", "read", "data/xa1", {"team": "red"}),
         (7, "ruled", "mallory", "read", "data/x_1", {"team": "red"})],
        "request_id long, policy_id string, subject string, action string, resource string, context map<string,string>",
    )
    policies = spark.createDataFrame([("on", True), ("off", False), ("ruled", True)], "policy_id string, active boolean")
    assert rows(governance.access_decisions(asked.where("request_id < 4"), policies), "request_id", "reason") == [
        (1, "policy evaluation passed"), (2, "policy is not active"), (3, "policy not found")]
    rules = spark.createDataFrame(
        [("ruled", "allow", ["read"], ["data/x_*"], "team", "equals", "red"), ("ruled", "deny", [], [], "subject", "matches", "^mal")],
        "policy_id string, effect string, actions array<string>, resources array<string>, field string, operator string, value string",
    )
    got = dict(rows(governance.access_decisions(asked, policies, rules), "request_id", "reason"))
    assert got == {1: "policy evaluation passed", 2: "policy is not active", 3: "policy not found", 4: "policy evaluation passed",
                   5: "no rule matches", 6: "no rule matches", 7: "denied by rule"}


def test_retention_and_compliance(spark):
    table = spark.createDataFrame([(1, T0), (2, T0 - dt.timedelta(days=91))], "id long, at timestamp_ntz")
    assert rows(governance.within_retention(table, "at", 90, "2024-01-01 00:00:00"), "id") == [(1,)]
    assert rows(governance.past_retention(table, "at", 90, "2024-01-01 00:00:00"), "id") == [(2,)]
    datasets = spark.createDataFrame([("t", "a"), ("t", "b")], "tenant_id string, dataset string")
    rules = spark.createDataFrame([("t", "GDPR", True, True, True)], "tenant_id string, framework string, active boolean, audit_required boolean, lineage_tracking boolean")
    gaps = governance.compliance_gaps(datasets, rules, datasets.where("dataset = 'a'"), datasets.where("dataset = 'b'"))
    assert rows(gaps, "dataset", "gap") == [("a", "audit"), ("b", "lineage")]


def test_reach_counts_of_many_roots(spark):
    """More roots than one word has bits, cycles, a root without edges, repeated edges and NULLs."""
    import random

    from assayer.operators import lineage

    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(220)]
    edges = spark.createDataFrame([*pairs, *pairs[:9], (None, "n1"), ("n2", None)], "source string, target string")
    names = [f"n{i}" for i in range(150)] + ["alone"]
    roots = spark.createDataFrame([(n,) for n in [*names, "n1"]], "node string")
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    want = {}
    for root in names:
        depth, seen, front = 0, {root}, {root}
        while True:
            front = {b for a in front for b in after.get(a, ())} - seen
            if not front:
                break
            depth, seen = depth + 1, seen | front
        want[root] = (len(seen) - 1, depth)
    assert {r.root: (r.reached, r.depth) for r in lineage.reach_counts(edges, roots).collect()} == want
    near = {r.root: r.reached for r in lineage.reach_counts(edges, roots, max_depth=1).collect()}
    assert near == {n: len(after.get(n, set()) - {n}) for n in names}


def test_leaves_of_reach_counts_are_spread_and_not_joined(spark, monkeypatch):
    """No hop starts from leaves, and the aggregations hold a bounded number of rows a task."""
    from assayer.operators import lineage

    asked, write = [], lineage._written
    monkeypatch.setattr(lineage, "ROWS_PER_TASK", 50, raising=False)
    monkeypatch.setattr(lineage, "_written", lambda df, label: (asked.append(label), write(df, label))[1])
    edges = spark.createDataFrame([("top", f"mid{i % 20}") for i in range(20)] + [(f"mid{i % 20}", f"leaf{i}") for i in range(400)], "source string, target string")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node"))
    counts = lineage.reach_counts(edges, nodes)
    assert {r.reached for r in counts.where("root like 'mid%'").collect()} == {20}
    assert counts.count() == 421 and rows(counts.where("depth = 2")) == [("top", 420, 2)]
    assert asked.count("frontier") == 3  # the roots and two hops; none from the leaves
    assert max(r["n"] for r in counts.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()) < 150


def test_closure_grows_with_its_edges(spark, tmp_path):
    """Random edges in batches, with cycles, repeats and edges that shorten paths: always the closure from scratch."""
    import random

    from assayer.operators import lineage

    rng = random.Random(8)
    closure, edges = lineage.Closure(spark, str(tmp_path / "closure")), set()
    assert closure.rows().count() == 0
    for size in (12, 1, 9):
        batch = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(size)]
        edges |= set(batch)
        closure.add(spark.createDataFrame([*batch, (None, "x"), *batch[:2]], "source string, target string"))
        best = {e: 1 for e in edges}
        for _ in range(25):
            for (a, b), d in list(best.items()):
                for c in (c for s, c in edges if s == b):
                    best[a, c] = min(best.get((a, c), 99), d + 1)
        assert {(r.root, r.node): r.depth for r in closure.rows().collect()} == best
    closure.add(spark.createDataFrame([], "source string, target string"))
    assert closure.rows().count() == len(best) and len(list((tmp_path / "closure").iterdir())) == 2


def test_closure_writes_its_rows_a_fixed_number_of_times(spark, tmp_path, monkeypatch):
    """A chain with leaves at its end takes several rounds; its leaves take part in none."""
    from assayer.operators import lineage

    sizes, write = [], lineage._written
    monkeypatch.setattr(lineage, "_written", lambda df, label: (sizes.append((out := write(df, label)).count()), out)[1])
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n9", f"leaf{i}") for i in range(100)]
    closure = lineage.Closure(spark, str(tmp_path / "closure"))
    closure.add(spark.createDataFrame(pairs, "source string, target string"))
    assert closure.rows().count() == 45 + 10 * 100
    assert sum(sizes) < 1.5 * closure.rows().count()


def test_requests_meet_only_rules_that_can_fit(spark):
    """Against every rule tried on every request, with odd patterns, actions and NULLs; and few rows enter the match."""
    import fnmatch
    import random

    rng = random.Random(2)
    patterns = ["data/x*", "data/x/1", "*", "*/9", "d*ta/*", "", "data/%_*", "data/x/1*", "logs/*"]
    rules = [(f"p{rng.randrange(6)}", rng.choice(["allow", "allow", "deny"]), rng.choice([[], ["*"], ["read"], ["read", "write", "read"], ["*", "write"]]),
              rng.sample(patterns, rng.randrange(3)), None, None, None) for _ in range(40)]
    asked = [(i, f"p{rng.randrange(8)}", "ann", rng.choice(["read", "write", "*", "own"]), rng.choice(["data/x/1", "data/x", "data/%_a", "logs/9", "", "dta/", None]), {}) for i in range(300)]
    frame = spark.createDataFrame(asked, "request_id long, policy_id string, subject string, action string, resource string, context map<string,string>")
    table = spark.createDataFrame(rules, "policy_id string, effect string, actions array<string>, resources array<string>, field string, operator string, value string")
    active = spark.createDataFrame([(f"p{i}", True) for i in range(8)], "policy_id string, active boolean")
    fits = lambda rule, r: (not rule[2] or "*" in rule[2] or r[3] in rule[2]) and (not rule[3] or r[4] is not None and any(fnmatch.fnmatchcase(r[4], p.replace("[", "[[]")) for p in rule[3]))
    want = {}
    for r in asked:
        own = [x for x in rules if x[0] == r[1]]
        hit = {x[1] for x in own if fits(x, r)}
        want[r[0]] = "policy evaluation passed" if not own else "denied by rule" if "deny" in hit else "policy evaluation passed" if hit else "no rule matches"
    assert dict(rows(governance.access_decisions(frame, active, table), "request_id", "reason")) == want
    tried = frame.join(table, "policy_id").count()
    indexed = governance.rule_index(table)
    met = governance.fitting_rules(frame.join(governance._looked_up(table, indexed), "policy_id"), indexed)
    assert met.where(governance._rule_matches()).count() <= met.count() < tried


def test_the_index_keeps_what_enters_the_match_small(spark):
    """On the registered query's rules: at most twice the rows that match."""
    from workload.governance import access_rules, requests

    rules, asked = access_rules(spark, "/root/testdata/sf0.01"), requests(spark, "/root/testdata/sf0.01")
    indexed = governance.rule_index(rules)
    met = governance.fitting_rules(asked.join(governance._looked_up(rules, indexed), "policy_id"), indexed)
    matching = met.where(governance._rule_matches()).count()
    assert 0 < matching and met.count() <= 2 * matching
