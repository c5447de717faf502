"""Mixing sources to target weights by pivotal dependent rounding.

A document should be taken ``target / source_size`` times; of equal rows, which are one unit, all of them
together. The whole part of that is taken outright. The fractional parts of a source, each below one
document, are rounded against each other: two units swap probability mass, weighted by their words so that
the source's total stays as it is, until one of them is 0 or 1. Chunks of units are folded that way; each
leaves one undecided unit, and these are folded again, level by level, until one per source is left, which
a last draw decides. The words of a source so miss its target by less than one document, and every unit
keeps its expected share.

Chunks have a bounded expected length, so a source with most of the rows is spread over many tasks.
All draws depend on the documents and the seed alone: reruns agree.

NULL sources are one source, last in order. Units without words (NULL or empty text) are taken 0
words. Rows equal in source, id, size and text are one unit; its copies are dealt over its rows, so that
two rows differ by one at most. Texts are counted whole. Other columns of any name stay as they are; one
named like the result's column of copies is replaced. An empty table gives an empty result. The number of sources is that of a mixture's recipe: their weights are
laid out by one window over one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.text import fingerprint, free, kept, sieved, unit_draw, words

WEIGHTS = (1, 2, 3)
CAP = 3
#: Expected units of a chunk.
CHUNK = 48
#: Equal rows that are numbered in one task, expected.
ROWS_PER_GROUP = 100_000
KEYS = ["source", "doc_id", "size", "print"]


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Sources with (source, source_size, weight, target).

    Sources in code point order, NULL last, get the weights in turn, and share the sum of all sizes
    by weight; a target stops at ``cap`` times its source, and what is left is shared again. That
    is one level: sources are sorted by the level at which they fill up, and the level is the first
    one that no further source is filled by.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))))
    listed = per_source.withColumn("place", place).withColumn("weight", weight)
    by_level = Window.orderBy(F.lit(float(cap)) * F.col("source_size") / F.col("weight"), "place")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = F.coalesce(F.sum(F.col("source_size")).over(before), F.lit(0)) * float(cap)
    level = (F.sum("source_size").over(everything) - filled) / F.sum("weight").over(after)
    fits = level * F.col("weight") <= F.col("source_size") * float(cap)
    listed = listed.withColumn("level", level).withColumn("fits", fits)
    first = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("source_size") * float(cap), first * F.col("weight"))
    return listed.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "weight", "target")


def _swap(seed: int, level: int):
    """One step of a fold: the carried unit and the next one swap mass until one is decided."""

    def step(state: Column, unit: Column) -> Column:
        carried, p, wa, q, wb = state["carry"], state["carry"]["p"], state["carry"]["w"], unit["p"], unit["w"]
        up, down = F.least(wa * (1 - p), wb * q), F.least(wa * p, wb * (1 - q))
        ids = [F.lit(seed), F.lit(level), carried["doc_id"], carried["print"], unit["doc_id"], unit["print"]]
        to_carried = unit_draw(*ids) * (up + down) < down

        def moved(u, p):
            return F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["print"].alias("print"), u["w"].alias("w"), p.alias("p"))

        def pair(left, right):
            return F.struct(left.alias("undecided"), right.alias("decided"))

        carried_full = wa * (1 - p) <= wb * q
        carried_empty = wa * p <= wb * (1 - q)
        one, none = F.lit(1.0), F.lit(0.0)
        outcome = (
            F.when(to_carried & carried_full, pair(moved(unit, q - up / wb), moved(carried, one)))
            .when(to_carried, pair(moved(carried, p + up / wa), moved(unit, none)))
            .when(carried_empty, pair(moved(unit, q + down / wb), moved(carried, none)))
            .otherwise(pair(moved(carried, p - down / wa), moved(unit, one)))
        )
        swapped = F.transform(F.array(outcome), lambda o: F.struct(o["undecided"].alias("carry"), F.concat(state["done"], F.array(o["decided"])).alias("done")))
        return F.when(carried.isNull(), F.struct(unit.alias("carry"), state["done"].alias("done"))).otherwise(F.get(swapped, F.lit(0)))

    return step


def rounded(units: DataFrame, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Units (source, doc_id, size, print, w, p) with ``bit``: 0 or 1 with mean p, and the sum of w * bit per source kept."""
    unit_type = "struct<doc_id:bigint,size:bigint,print:bigint,w:double,p:double>"
    decided, level, current = None, 0, units
    nothing = F.struct(F.lit(None).cast(unit_type).alias("carry"), F.array().cast(f"array<{unit_type}>").alias("done"))
    while True:
        counts = kept(current.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
        most = counts.agg(F.max("n")).first()[0] or 0
        slot = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "print", "size"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") / chunk)))
        placed = current.join(counts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("slot", slot)
        order = unit_draw(F.lit(seed + 1), F.lit(level), F.col("doc_id"), F.col("print"), F.col("size"))
        unit = F.struct(order.alias("o"), F.struct("doc_id", "size", "print", "w", "p").cast(unit_type).alias("u"))
        chunks = placed.groupBy("source", "slot").agg(F.sort_array(F.collect_list(unit)).alias("units"))
        folded = F.aggregate(F.transform("units", lambda x: x["u"]), nothing, _swap(seed, level))
        step = kept(chunks.select("source", folded.alias("f")).select("source", "f.carry", "f.done"), "mixing-level")
        settled = step.select("source", F.explode("done").alias("u")).select("source", "u.*")
        current = step.select("source", "carry.*")
        decided = settled if decided is None else decided.unionByName(settled)
        if most <= chunk:  # every source was one chunk
            break
        level += 1
    draw = unit_draw(F.lit(seed + 2), F.col("doc_id"), F.col("print"), F.col("size"))
    last = current.withColumn("p", F.when(draw < F.col("p"), 1.0).otherwise(0.0))
    return decided.unionByName(last).select(*KEYS, F.col("p").cast("bigint").alias("bit"))


def plan(units: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 0) -> DataFrame:
    """Times each unit is taken: units (source, doc_id, size, print, rows) with source_size, target, and the copies of
    every one of its rows (``each``) and of how many rows one more (``extra``)."""
    shares = kept(targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, cap), "mixing-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = units.join(shares.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight").withColumn("rate", rate)
    wanted = (F.col("rate") - F.floor("rate")) * F.col("rows")
    rated = rated.withColumn("whole", F.floor("rate") * F.col("rows") + F.floor(wanted)).withColumn("p", wanted - F.floor(wanted))
    open_ = rated.where("p > 0 and size > 0").select(*KEYS, F.col("size").cast("double").alias("w"), "p")
    bits = rounded(open_, seed)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    bits = bits.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "bit")
    on = same[0] & same[1] & same[2] & same[3]
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("bit", F.lit(0))).otherwise(0)
    taken = rated.join(bits, on, "left").select(*KEYS, "rows", "source_size", "target", copies.cast("bigint").alias("copies"))
    return taken.select(*KEYS, "rows", "source_size", "target", F.expr("copies div rows").alias("each"), F.expr("copies % rows").alias("extra"))


def units_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Distinct (source, doc_id, size, print) with the number of equal rows, from the whole texts."""
    light = docs.select(F.col(source).alias("source"), F.col(doc_id).cast("bigint").alias("doc_id"), F.size(words(F.col(text))).cast("bigint").alias("size"), fingerprint(F.col(text)).alias("print"))
    return kept(light.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows")), "mixing-units")


def mix_table(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 0) -> DataFrame:
    """One row per document row: doc_id, source, size, source_size, target, taken and copies."""
    planned = plan(units_of(docs), weights, cap, seed)
    rows = planned.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    copies = F.col("each") + (F.col("row") <= F.col("extra")).cast("bigint")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def _numbered(rows: DataFrame, unit: str, row: str, group: str) -> DataFrame:
    """(row, number): the rows of each unit numbered from 1, ``group`` holding rows of one task each."""
    light = rows.select(F.col(unit).alias("u"), F.col(row).alias("r"), F.col(group).alias("g"))
    before = F.sum("n").over(Window.partitionBy("u").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    groups = light.groupBy("u", "g").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("u", "g").orderBy("r"))
    return light.withColumn("inside", inside).join(groups, ["u", "g"]).select("r", (F.col("inside") + F.col("before")).alias("number"))


def _outcomes(planned: DataFrame, source: str, each: str, extra: str) -> DataFrame:
    """The two most frequent copies of a row in every source: (_source, most, next), one row per source."""
    counts = planned.where(F.col(extra) == 0).groupBy(F.col(source).alias("_source"), F.col(each).alias("copies")).agg((-F.count(F.lit(1))).alias("n"))
    ranked = counts.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("n", "copies"))).alias("o"))
    return ranked.select("_source", F.get("o", F.lit(0))["copies"].alias("most"), F.get("o", F.lit(1))["copies"].alias("next"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, seed: int = 0, copies: str = "copies") -> DataFrame:
    """The mixed corpus: each document with the number of times it is taken, those taken 0 times left out.

    Nearly all units of a source are taken one of two numbers of times. A row whose unit is surely not among those
    taken other than the one, or other than the other, is dealt where it is; the rest is moved and looked up.
    """
    docs = docs.drop(copies)
    n = {k: free(docs, f"mix_{k}") for k in ("source", "doc_id", "print", "rows", "each", "extra", "unit", "row", "group", "number", "most", "next", "other", "another")}
    planned = plan(units_of(docs), weights, cap, seed).withColumn("unit", F.monotonically_increasing_id())
    planned = kept(planned.select(*[F.col(k).alias(n[k]) for k in ("source", "doc_id", "print", "rows", "each", "extra", "unit")]), "mixing-plan")
    usual = kept(_outcomes(planned, n["source"], n["each"], n["extra"]).toDF("_source", n["most"], n["next"]), "mixing-outcomes")
    compared = planned.join(F.broadcast(usual), F.col(n["source"]).eqNullSafe(F.col("_source")), "left")
    besides = lambda o: compared.where(~(F.col(n["each"]).eqNullSafe(F.col(n[o])) & (F.col(n["extra"]) == 0))).select(F.xxhash64(n["source"], n["doc_id"], n["print"]))
    its_source = free(docs, n["source"] + "_")
    marked = docs.join(F.broadcast(usual.withColumnRenamed("_source", its_source)), F.col("source").eqNullSafe(F.col(its_source)), "left")
    key = F.xxhash64("source", F.col("doc_id").cast("bigint"), fingerprint(F.col("text")))
    marked = sieved(sieved(marked, key, besides("most"), n["other"]), key, besides("next"), n["another"])
    sure = F.when(~F.col(n["other"]), F.col(n["most"])).when(~F.col(n["another"]), F.col(n["next"]))
    dealt_here = marked.withColumn(copies, sure).where(F.col(copies) > 0).select(*docs.columns, copies)
    asked = marked.where(sure.isNull()).select(*docs.columns)

    on = F.col("source").eqNullSafe(F.col(n["source"])) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(n["doc_id"])) & (fingerprint(F.col("text")) == F.col(n["print"]))
    taken = planned.where((F.col(n["each"]) > 0) | (F.col(n["extra"]) > 0))
    even = asked.join(taken.where(F.col(n["extra"]) == 0), on).withColumn(copies, F.col(n["each"])).select(*docs.columns, copies)
    even = dealt_here.unionByName(even)
    uneven = taken.where(F.col(n["extra"]) > 0)
    if uneven.isEmpty():
        return even
    # Only rows of units whose copies do not divide by their rows are numbered; they are written, which fixes the numbers.
    tied = asked.join(uneven, on).withColumn(n["row"], F.monotonically_increasing_id())
    tied = kept(tied.withColumn(n["group"], F.pmod(F.xxhash64(n["row"]), F.ceil(F.col(n["rows"]) / ROWS_PER_GROUP))), "mixing-tied")
    numbers = _numbered(tied, n["unit"], n["row"], n["group"]).select(F.col("r").alias(n["row"]), F.col("number").alias(n["number"]))
    dealt = F.col(n["each"]) + (F.col(n["number"]) <= F.col(n["extra"])).cast("bigint")
    return even.unionByName(tied.join(numbers, n["row"]).withColumn(copies, dealt).where(F.col(copies) > 0).select(*docs.columns, copies))
