"""Relationship tuples to effective permissions.

Tuples are rows (user, relation, object_type, object_id). An object names its tenant by a
``parent`` tuple whose user is ``tenant:<id>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relations that holding one relation on an object grants there.
GRANTS = {
    "tenant": {
        "owner": ("owner", "member"),
        "admin": ("admin", "member"),
        "editor": ("editor", "member"),
        "viewer": ("viewer", "member"),
        "member": ("member",),
    },
    "policy": {"owner": ("owner", "editor", "viewer"), "editor": ("editor", "viewer"), "viewer": ("viewer",)},
    "workflow": {"owner": ("owner", "editor", "viewer"), "editor": ("editor", "viewer"), "viewer": ("viewer",)},
    "lineage": {"owner": ("owner", "viewer"), "viewer": ("viewer",)},
}
# Tenant relations that carry over to objects of the tenant.
INHERITED = {
    "policy": ("owner", "editor", "viewer"),
    "workflow": ("owner", "editor", "viewer"),
    "lineage": ("owner", "viewer"),
}
RELATIONS = ("owner", "admin", "editor", "viewer", "member")
TENANT_PREFIX = "tenant:"


def _holders_of() -> dict[str, dict[str, tuple]]:
    """For each relation, the relations on the same object that grant it."""
    out: dict[str, dict[str, tuple]] = {}
    for kind, held in GRANTS.items():
        wanted = {r for granted in held.values() for r in granted}
        out[kind] = {w: tuple(h for h, granted in held.items() if w in granted) for w in wanted}
    return out


def _parents(tuples: DataFrame) -> DataFrame:
    named = F.col("user").startswith(TENANT_PREFIX) & (F.col("relation") == "parent")
    return tuples.where(named).select(
        "object_type", "object_id", F.substring("user", len(TENANT_PREFIX) + 1, 2**31 - 1).alias("tenant_id")
    ).distinct()


#: Rows one task makes distinct at most.
ROWS_PER_TASK = 500_000
#: Tasks of one stage at most; beyond, tasks have more rows.
MOST_TASKS = 20_000


def effective_permissions(tuples: DataFrame) -> DataFrame:
    """All (user, relation, object_type, object_id) that hold, directly or through the tenant.

    What a user holds on an object is one bit set until the end. Members of a tenant and its objects are
    counted first, so that their product is spread over as many tasks as its size asks for.
    """
    facts = tuples.where(F.col("relation") != "parent").select("user", "relation", "object_type", "object_id")
    kind, relation = F.col("object_type"), F.col("relation")
    held_here = _mask(kind, relation, GRANTS)
    direct = facts.select("user", "object_type", "object_id", held_here.alias("held")).where("held <> 0")
    members = facts.where(kind == "tenant").groupBy("user", F.col("object_id").alias("tenant_id")).agg(F.bit_or(_bit(relation)).alias("bits"))
    parents = _parents(tuples)
    pieces = _pieces(tuples)
    inherited = parents.join(members, "tenant_id").select("user", "object_type", "object_id", _carried(kind, F.col("bits")).alias("held"))
    every = direct.unionByName(inherited.where("held <> 0"))
    spread = every.repartition(pieces, "user", "object_type", "object_id")
    sets = spread.groupBy("user", "object_type", "object_id").agg(F.bit_or("held").alias("held"))
    return sets.select("user", F.explode(_relations(F.col("held"))).alias("relation"), "object_type", "object_id")


def _pieces(tuples: DataFrame) -> int:
    """Tasks over which all direct and inherited rows are spread."""
    parent = (F.col("relation") == "parent") & F.col("user").startswith(TENANT_PREFIX)
    fact = F.col("relation") != "parent"
    member = fact & (F.col("object_type") == "tenant")
    tenant = F.when(parent, F.substring("user", len(TENANT_PREFIX) + 1, 2**31 - 1)).when(member, F.col("object_id"))
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    per_tenant = tuples.groupBy(tenant.alias("tenant_id")).agg(count(parent).alias("objects"), count(member).alias("members"), count(fact).alias("own"))
    rows = per_tenant.agg(F.sum(F.col("objects") * F.col("members") + F.col("own")).alias("rows")).first().rows or 0
    return min(MOST_TASKS, int(rows // ROWS_PER_TASK) + 1)


def _carried(kind: Column, bits: Column) -> Column:
    """What the tenant relations of a bit set grant on an object of the tenant, as a bit set."""
    carried = F.lit(0)
    for name, inherited in INHERITED.items():
        every = F.lit(0)
        for r in inherited:
            every = every.bitwiseOR(F.when(bits.bitwiseAND(F.lit(1 << RELATIONS.index(r))) != 0, F.lit(_bits(GRANTS[name][r]))).otherwise(F.lit(0)))
        carried = F.when(kind == name, every).otherwise(carried)
    return carried


def _relations(held: Column) -> Column:
    """The relations of a bit set, as an array."""
    return F.array_compact(F.array(*[F.when(held.bitwiseAND(F.lit(1 << i)) != 0, F.lit(r)) for i, r in enumerate(RELATIONS)]))


def _mask(object_type: Column, relation: Column, table: dict[str, dict[str, tuple]]) -> Column:
    """The relations a lookup table names, as a bit set over RELATIONS."""
    expr = F.lit(0)
    for kind, relations in table.items():
        for name, values in relations.items():
            expr = F.when((object_type == kind) & (relation == name), F.lit(_bits(values))).otherwise(expr)
    return expr


def _bits(relations: tuple[str, ...]) -> int:
    return sum(1 << RELATIONS.index(r) for r in relations)


def _bit(relation: Column) -> Column:
    expr = F.lit(0)
    for position, name in enumerate(RELATIONS):
        expr = F.when(relation == name, F.lit(1 << position)).otherwise(expr)
    return expr


def permission_sets(tuples: DataFrame, users: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """(user, object_type, object_id, relations) of the asked users (user) and/or objects (object_type, object_id).

    One side must be asked for: all members on all objects of a tenant is a product that grows with both.
    The asked side meets the tuples before members meet objects, so only its rows do. What a user holds
    on an object is one bit set, directly and through the tenant together, spelled out at the end as a
    sorted array. Repeated asked rows count once, NULL ones never; unknown ones have no rows.
    """
    if users is None and objects is None:
        raise ValueError("ask for users, objects or both")
    facts = tuples.where(F.col("relation") != "parent").select("user", "relation", "object_type", "object_id")
    parents = _parents(tuples)
    members = facts.where(F.col("object_type") == "tenant")
    if users is not None:
        asked = users.select("user").distinct()
        facts, members = facts.join(asked, "user", "left_semi"), members.join(asked, "user", "left_semi")
    if objects is not None:
        wanted = objects.select("object_type", "object_id").distinct()
        facts, parents = (df.join(wanted, ["object_type", "object_id"], "left_semi") for df in (facts, parents))
    kind, relation = F.col("object_type"), F.col("relation")
    direct = facts.select("user", "object_type", "object_id", _mask(kind, relation, GRANTS).alias("held"))
    held = members.groupBy("user", F.col("object_id").alias("tenant_id")).agg(F.bit_or(_bit(relation)).alias("bits"))
    inherited = parents.join(held, "tenant_id").select("user", "object_type", "object_id", _carried(kind, F.col("bits")).alias("held"))
    sets = direct.union(inherited).groupBy("user", "object_type", "object_id").agg(F.bit_or("held").alias("held")).where("held <> 0")
    return sets.select("user", "object_type", "object_id", F.sort_array(_relations(F.col("held"))).alias("relations"))


def batch_check(requests: DataFrame, tuples: DataFrame) -> DataFrame:
    """Requests (request_id, user, relation, object_type, object_id) with an ``allowed`` flag.

    A request asks for two facts: a granting relation on the object itself, or an inherited
    one on its tenant. Both are looked up by (user, object) with the held relations as a
    bit set, so the cost follows the requests and not the size of all permissions.
    """
    holders = _holders_of()
    carried = {
        kind: {r: tuple(h for h in held_by if h in INHERITED[kind]) for r, held_by in holders[kind].items()}
        for kind in INHERITED
    }
    keys = ["request_id", "user", "relation", "object_type", "object_id"]
    place = lambda kind, key, need: F.struct(kind.alias("kind"), key.alias("key"), need.alias("need"))
    asked = F.col("object_type"), F.col("relation")
    places = F.array(
        place(F.col("object_type"), F.col("object_id"), _mask(*asked, holders)),
        place(F.lit("tenant"), F.col("tenant_id"), _mask(*asked, carried)),
    )
    candidates = (
        requests.select(*keys)
        .join(_parents(tuples), ["object_type", "object_id"], "left")
        .select(*keys, F.explode(places).alias("p"))
        .select(*keys, "p.*")
    )
    facts = tuples.groupBy("user", F.col("object_type").alias("kind"), F.col("object_id").alias("key")).agg(
        F.bit_or(_bit(F.col("relation"))).alias("held")
    )
    met = F.coalesce(F.col("held").bitwiseAND(F.col("need")), F.lit(0)) != 0
    return candidates.join(facts, ["user", "kind", "key"], "left").groupBy(*keys).agg(F.bool_or(met).alias("allowed"))


def list_objects(tuples: DataFrame, user: str, relation: str, object_type: str) -> DataFrame:
    """Objects of a type on which one user holds a relation."""
    mine = tuples.where((F.col("user") == user) | (F.col("relation") == "parent"))
    return (
        effective_permissions(mine)
        .where((F.col("relation") == relation) & (F.col("object_type") == object_type))
        .select("object_id")
    )
