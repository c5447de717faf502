"""Permissions of asked users and objects as bit sets, and folders listed by the tasks."""

import pytest
from pyspark.sql import functions as F

from assayer.operators import access
from assayer.sources import listing
from tests.conftest import plan_of, rows

TUPLES = [
    ("ann", "owner", "tenant", "1"), ("bob", "viewer", "tenant", "1"), ("bob", "editor", "tenant", "2"), ("cat", "member", "tenant", "1"),
    ("tenant:1", "parent", "policy", "p"), ("tenant:2", "parent", "policy", "p"), ("tenant:1", "parent", "lineage", "l"),
    ("bob", "owner", "lineage", "l"), ("dan", "editor", "workflow", "w"), ("dan", "editor", "workflow", "w"), (None, "owner", "policy", "p"),
    ("eve", None, "policy", "p"), ("eve", "owner", "unheard", "x"),
]


@pytest.fixture
def tuples(spark):
    return spark.createDataFrame(TUPLES, "user string, relation string, object_type string, object_id string")


def sets(df):
    return {(u, t, o): set(r) for u, t, o, r in df.select("user", "object_type", "object_id", "relations").collect()}


def test_permissions_of_a_large_tenant_are_spread(spark, monkeypatch):
    """Tasks hold a bounded number of rows, and what is granted twice is there once."""
    monkeypatch.setattr(access, "ROWS_PER_TASK", 50, raising=False)
    members = [(f"u{i}", r, "tenant", "1") for i in range(40) for r in ("owner", "editor")]
    objects = [("tenant:1", "parent", "policy", f"p{i}") for i in range(30)] + [("tenant:2", "parent", "policy", "p0"), ("u1", "viewer", "tenant", "2")]
    held = access.effective_permissions(spark.createDataFrame([*members, *objects, objects[0]], "user string, relation string, object_type string, object_id string"))
    want = {(f"u{i}", r, "policy", f"p{j}") for i in range(40) for j in range(30) for r in ("owner", "editor", "viewer")}
    want |= {(f"u{i}", r, "tenant", "1") for i in range(40) for r in ("owner", "editor", "member")} | {("u1", r, "tenant", "2") for r in ("viewer", "member")}
    got = [tuple(r) for r in held.collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(r["n"] for r in held.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 400


def test_sets_are_the_effective_permissions_of_the_asked(spark, tuples):
    every = {}
    for u, r, t, o in access.effective_permissions(tuples).select("user", "relation", "object_type", "object_id").collect():
        every.setdefault((u, t, o), set()).add(r)
    users = spark.createDataFrame([("ann",), ("bob",), ("bob",), (None,), ("nobody",)], "user string")
    objects = spark.createDataFrame([("policy", "p"), ("lineage", "l"), ("lineage", None)], "object_type string, object_id string")
    of_users = {k: v for k, v in every.items() if k[0] in ("ann", "bob")}
    of_objects = {k: v for k, v in every.items() if k[1:] in (("policy", "p"), ("lineage", "l"))}
    assert sets(access.permission_sets(tuples, users)) == of_users and len(of_users) >= 6
    assert sets(access.permission_sets(tuples, objects=objects)) == of_objects
    assert sets(access.permission_sets(tuples, users, objects)) == {k: v for k, v in of_users.items() if k in of_objects}
    assert access.permission_sets(tuples.limit(0), users).count() == 0 and access.permission_sets(tuples, users.limit(0)).count() == 0
    with pytest.raises(ValueError):
        access.permission_sets(tuples)


def test_members_meet_objects_only_where_they_are_asked_for(spark, tmp_path):
    """100 members and 400 objects of one tenant: the join of one asked user makes 400 rows, not 40 000."""
    member = spark.range(100).select(F.concat(F.lit("u"), "id").alias("user"), F.lit("owner").alias("relation"), F.lit("tenant").alias("object_type"), F.lit("1").alias("object_id"))
    placed = spark.range(400).select(F.lit("tenant:1").alias("user"), F.lit("parent").alias("relation"), F.lit("policy").alias("object_type"), F.col("id").cast("string").alias("object_id"))
    asked = spark.createDataFrame([("u7",)], "user string")
    found = access.permission_sets(member.union(placed), asked)
    assert found.count() == 401
    metric = [line for line in plan_of(found).splitlines() if "Join" in line]
    assert metric and not any("Cartesian" in line or "NestedLoop" in line for line in metric)


def test_walked_trees_are_the_listed_ones(spark, tmp_path):
    root = tmp_path / "a b%c"
    for i in range(130):  # more folders than one task lists
        folder = root / f"d={i % 13}" / f"e {i}"
        folder.mkdir(parents=True)
        (folder / f"f{i}.csv").write_text("x\n" + "1\n" * i)
    (root / "top.PARQUET").write_bytes(b"1")
    (root / "empty.csv").write_bytes(b"")
    (root / "d=1" / "_hidden.csv").write_bytes(b"1")
    (root / "_gone").mkdir()
    (root / "_gone" / "x.csv").write_bytes(b"1")
    walked = listing.walk_files(spark, str(root))
    columns = ["path", "name", "size", "format"]
    assert rows(walked, *columns) == rows(listing.list_files(spark, str(root)), *columns)
    assert walked.count() == 131 and walked.where("last_modified is null").count() == 0
    assert rows(listing.walk_files(spark, str(root), "top.*"), "name") == [("top.PARQUET",)]
    counts = listing.row_counts(spark, str(root), files=listing.walk_files(spark, str(root), "*.csv"))
    assert sorted(r.row_count for r in counts.collect()) == list(range(130))


def test_a_missing_root_raises(spark, tmp_path):
    with pytest.raises(Exception, match="No such file|not exist|Cannot"):
        listing.walk_files(spark, str(tmp_path / "none"))
