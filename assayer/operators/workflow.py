"""Workflows as transition tables, and replay of event logs against them.

A transition maps every state to a state, and such maps compose associatively. A log is
therefore replayed in pieces: range partitioning puts the events in (entity, time) order,
every task folds the stretch it holds for all possible start states at once, and the few
stretches per entity are chained afterwards. An entity that owns a third of the log is
spread over many tasks, and no task holds more than its own partition's stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.specs import SpecError


@dataclass(frozen=True)
class Workflow:
    """``transitions`` are (event, source states, destination state)."""

    name: str
    initial: str
    transitions: tuple[tuple[str, tuple[str, ...], str], ...]

    @property
    def states(self) -> list[str]:
        found = {self.initial}
        for _, sources, target in self.transitions:
            found |= {*sources, target}
        return sorted(found)

    @property
    def events(self) -> list[str]:
        return sorted({event for event, _, _ in self.transitions})


# The standard workflows.
DATA_QUALITY = Workflow(
    "data_quality",
    "pending",
    (
        ("start", ("pending",), "running"),
        ("validate", ("running",), "validating"),
        ("pass", ("validating",), "passed"),
        ("fail", ("validating",), "failed"),
        ("retry", ("failed",), "pending"),
        ("complete", ("passed",), "completed"),
        ("abort", ("pending", "running", "validating"), "aborted"),
    ),
)
APPROVAL = Workflow(
    "approval",
    "draft",
    (
        ("submit", ("draft",), "submitted"),
        ("review", ("submitted",), "under_review"),
        ("approve", ("under_review",), "approved"),
        ("reject", ("under_review",), "rejected"),
        ("request_changes", ("under_review",), "changes_requested"),
        ("resubmit", ("changes_requested", "rejected"), "submitted"),
        ("cancel", ("draft", "submitted", "under_review"), "cancelled"),
    ),
)
DATA_PIPELINE = Workflow(
    "data_pipeline",
    "pending",
    (
        ("start", ("pending",), "running"),
        ("extract", ("running",), "extracting"),
        ("transform", ("extracting",), "transforming"),
        ("load", ("transforming",), "loading"),
        ("complete", ("loading",), "completed"),
        ("fail", ("extracting", "transforming", "loading"), "failed"),
        ("retry", ("failed",), "pending"),
        ("abort", ("pending", "running", "extracting", "transforming", "loading"), "aborted"),
    ),
)
STANDARD = (DATA_QUALITY, APPROVAL, DATA_PIPELINE)


def transition_table(spark: SparkSession, workflows: tuple[Workflow, ...] = STANDARD) -> DataFrame:
    """One row per workflow, event, source and destination state."""
    rows = [(w.name, event, list(sources), target) for w in workflows for event, sources, target in w.transitions]
    table = spark.createDataFrame(rows, "workflow string, event string, src array<string>, dst string")
    return table.select("workflow", "event", F.explode("src").alias("src"), "dst")


def available_transitions(current: DataFrame, workflow: Workflow) -> DataFrame:
    """Events each entity's current state allows: rows (entity, state, event, next_state)."""
    table = transition_table(current.sparkSession, (workflow,)).select(
        F.col("src").alias("state"), "event", F.col("dst").alias("next_state")
    )
    # One row per transition of one definition, so broadcasting it is safe.
    return current.join(F.broadcast(table), "state").select("entity", "state", "event", "next_state")


def can_transition(requests: DataFrame, current: DataFrame, workflow: Workflow) -> DataFrame:
    """Requests (entity, event) with whether the entity's state allows the event."""
    table = transition_table(current.sparkSession, (workflow,)).select(F.col("src").alias("state"), "event", F.lit(True).alias("_ok"))
    known = requests.join(current.select("entity", "state"), "entity", "left").withColumn(
        "state", F.coalesce("state", F.lit(workflow.initial))
    )
    return known.join(F.broadcast(table), ["state", "event"], "left").select(
        "entity", "state", "event", F.coalesce("_ok", F.lit(False)).alias("allowed")
    )


# --------------------------------------------------------------------------- replay


class Automaton:
    """A workflow as arrays: next state and acceptance per (event code, state)."""

    def __init__(self, workflow: Workflow):
        self.states = workflow.states
        self.events = pa.array(workflow.events, pa.string())
        self.initial = self.states.index(workflow.initial)
        size = len(self.states)
        # One more row for events the workflow does not know: they are refused.
        self.step = np.tile(np.arange(size), (len(self.events) + 1, 1))
        self.accepts = np.zeros((len(self.events) + 1, size), dtype=bool)
        for event, sources, target in workflow.transitions:
            code = workflow.events.index(event)
            for source in sources:
                self.step[code, self.states.index(source)] = self.states.index(target)
                self.accepts[code, self.states.index(source)] = True

    def codes(self, events: pa.Array) -> np.ndarray:
        known = pc.index_in(events, value_set=self.events)
        return pc.fill_null(known, len(self.events)).to_numpy(zero_copy_only=False).astype(np.int64)

    def fold(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State after, acceptances and first refused position per segment and start state.

        ``starts`` are the first positions of the segments. Prefix compositions are built
        by doubling, so the Python work is logarithmic in the number of events.
        """
        n, size = len(codes), len(self.states)
        lengths = np.diff(np.append(starts, n))
        segment_start = np.repeat(starts, lengths)
        position = np.arange(n)
        after = self.step[codes]
        reach = 1
        while reach < lengths.max():
            rows = np.nonzero(position - reach >= segment_start)[0]
            after[rows] = np.take_along_axis(after[rows], after[rows - reach], axis=1)
            reach *= 2
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[starts] = np.arange(size)
        accepted = np.take_along_axis(self.accepts[codes], before, axis=1)
        counts = np.add.reduceat(accepted.astype(np.int64), starts, axis=0)
        refused_at = np.minimum.reduceat(np.where(accepted, n, position[:, None]), starts, axis=0)
        return after[starts + lengths - 1], counts, refused_at


STRETCH = (
    "entity string, first_ts timestamp_ntz, first_id long, total long, "
    "next_states array<int>, accepted array<long>, refused array<string>"
)


def _stretches(machine: Automaton, batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row per entity of a batch sorted by (entity, ts, event_id): the fold of its events."""
    n = batch.num_rows
    entity, event = batch.column("entity"), batch.column("event")
    group = pc.fill_null(entity.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    starts = np.nonzero(np.append(True, group[1:] != group[:-1]))[0]
    state, accepted, refused_at = machine.fold(machine.codes(event), starts)
    first = pa.array(starts)
    flat = refused_at.ravel()
    offsets = pa.array(np.arange(len(starts) + 1) * len(machine.states), pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    return pa.RecordBatch.from_pydict(
        {
            "entity": entity.take(first),
            "first_ts": batch.column("ts").take(first),
            "first_id": batch.column("event_id").take(first),
            "total": pa.array(np.diff(np.append(starts, n))),
            "next_states": lists(pa.array(state.ravel(), pa.int32())),
            "accepted": lists(pa.array(accepted.ravel())),
            "refused": lists(event.take(pa.array(flat, mask=flat == n))),
        }
    )


def _then(earlier: pa.RecordBatch, later: pa.RecordBatch) -> pa.RecordBatch:
    """Two consecutive stretches of one entity as one."""
    a, b = earlier.to_pylist()[0], later.to_pylist()[0]
    via = a["next_states"]
    joined = {
        **a,
        "total": a["total"] + b["total"],
        "next_states": [b["next_states"][s] for s in via],
        "accepted": [n + b["accepted"][s] for n, s in zip(a["accepted"], via)],
        "refused": [r if r is not None else b["refused"][s] for r, s in zip(a["refused"], via)],
    }
    return pa.RecordBatch.from_pylist([joined], schema=earlier.schema)


def _fold_partition(workflow: Workflow):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(workflow)
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _stretches(machine, batch)
            if held is not None and held.column("entity")[0] == found.column("entity")[0]:
                head, found = _then(held, found.slice(0, 1)), found.slice(1)
                if not found.num_rows:
                    held = head
                    continue
                yield head
            elif held is not None:
                yield held
            # The last entity may go on in the next batch.
            held = found.slice(found.num_rows - 1)
            if found.num_rows > 1:
                yield found.slice(0, found.num_rows - 1)
        if held is not None:
            yield held

    return run


def replay(log: DataFrame, workflow: Workflow, partitions: int | None = None) -> DataFrame:
    """Final state of every entity after its events, in (ts, event_id) order.

    ``log`` has entity, event, ts and event_id. An event that the current state does not
    allow is refused and leaves the state as it is.
    """
    return followed(stretches(log, workflow, partitions), workflow)


def stretches(log: DataFrame, workflow: Workflow, partitions: int | None = None) -> DataFrame:
    """What the events of an entity do to every state, a row per entity and range partition."""
    missing = {"entity", "event", "ts", "event_id"} - set(log.columns)
    if missing:
        raise SpecError(f"replay needs columns {sorted(missing)}")
    slim = log.select(
        F.col("entity").cast("string").alias("entity"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("event").cast("string").alias("event"),
    )
    order = ["entity", "ts", "event_id"]
    spread = slim.repartitionByRange(partitions, *order) if partitions else slim.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order).mapInArrow(_fold_partition(workflow), STRETCH)


def _chain(stretches: DataFrame, workflow: Workflow) -> DataFrame:
    """Follow each entity through its stretches, at most one per range partition: total and end (state, accepted, refused).

    A stretch without times comes before all others.
    """
    states = workflow.states
    at_front = F.col("first_ts").isNotNull().cast("int").alias("order")
    ordered = F.array_sort(
        F.collect_list(F.struct(at_front, "first_ts", "first_id", "next_states", "accepted", "refused"))
    )
    start = F.struct(
        F.lit(states.index(workflow.initial)).alias("state"),
        F.lit(0).cast("bigint").alias("accepted"),
        F.lit(None).cast("string").alias("refused"),
    )

    def follow(acc: Column, piece: Column) -> Column:
        return F.struct(
            F.get(piece["next_states"], acc["state"]).alias("state"),
            (acc["accepted"] + F.get(piece["accepted"], acc["state"])).alias("accepted"),
            F.coalesce(acc["refused"], F.get(piece["refused"], acc["state"])).alias("refused"),
        )

    return stretches.groupBy("entity").agg(F.sum("total").alias("total"), F.aggregate(ordered, start, follow).alias("end"))


def followed(stretches: DataFrame, workflow: Workflow) -> DataFrame:
    """Entities with the state their stretches lead to from the initial one."""
    names = F.array(*[F.lit(s) for s in workflow.states])
    chained = _chain(stretches, workflow)
    return chained.select(
        "entity",
        F.get(names, F.col("end.state")).alias("state"),
        F.col("end.accepted").alias("accepted"),
        (F.col("total") - F.col("end.accepted")).alias("rejected"),
        F.col("end.refused").alias("first_rejected"),
    )


# --------------------------------------------------------------------------- replay that goes on

#: What is kept of an entity between replays; the state is its number in the workflow.
HELD = "entity string, state int, accepted bigint, total bigint"


def continued(held: DataFrame, stretches: DataFrame, workflow: Workflow) -> DataFrame:
    """Rows HELD of the entities that have stretches, after them.

    What was held of an entity is one more stretch in front, which leads from any state to the held
    one; so held states and new stretches meet in one aggregation.
    """
    every = lambda value: F.array(*[value] * len(workflow.states))
    touched = stretches.select(F.col("entity").alias("_touched")).distinct()
    before = held.join(touched, F.col("entity").eqNullSafe(F.col("_touched")), "left_semi").select(
        "entity",
        F.lit(None).cast("timestamp_ntz").alias("first_ts"),
        F.lit(None).cast("bigint").alias("first_id"),
        "total",
        every(F.col("state")).alias("next_states"),
        every(F.col("accepted")).alias("accepted"),
        F.array_repeat(F.lit(None).cast("string"), len(workflow.states)).alias("refused"),
    )
    chained = _chain(before.unionByName(stretches), workflow)
    return chained.select("entity", F.col("end.state").cast("int").alias("state"), F.col("end.accepted").alias("accepted"), "total")


def described(held: DataFrame, workflow: Workflow) -> DataFrame:
    """Rows HELD as (entity, state, accepted, rejected), the state by its name."""
    names = F.array(*[F.lit(s) for s in workflow.states])
    return held.select("entity", F.get(names, F.col("state")).alias("state"), "accepted", (F.col("total") - F.col("accepted")).alias("rejected"))
