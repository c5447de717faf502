"""Continuous workflow replay: the current state of every entity kept between micro-batches.

``write_states`` keeps states as a table of versions and spreads the events of a hot entity over many
tasks; ``replay_stream`` keeps them in Spark's state store, where the events one entity brings in a
micro-batch are one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.operators.workflow import HELD, Automaton, Workflow, continued, described, stretches
from assayer.session import finished, removed, run_dir

OUTPUT = "entity string, state string, accepted long, rejected long"
STATE = "state int, accepted long, total long"


def replay_stream(log: DataFrame, workflow: Workflow) -> DataFrame:
    """Entities touched by each micro-batch with their state after it (update mode).

    Within a micro-batch the events of an entity are ordered by (ts, event_id); events that
    arrive in a later batch come later. The rows one entity can bring at once are bounded by
    the source's batch limit (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), which a
    stream with hot entities should set.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        machine = Automaton(workflow)
        state, accepted, total = held.get if held.exists else (machine.initial, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        codes = machine.codes(pa.array(rows["event"], pa.string()))
        after, counts, _ = machine.fold(codes, np.array([0]))
        accepted, total, state = accepted + int(counts[0, state]), total + len(rows), int(after[0, state])
        held.update((state, accepted, total))
        yield pd.DataFrame(
            {"entity": [key[0]], "state": [machine.states[state]], "accepted": [accepted], "rejected": [total - accepted]}
        )

    slim = log.select(F.col("entity").cast("string").alias("entity"), "event", "ts", "event_id")
    return slim.groupBy("entity").applyInPandasWithState(
        advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )


#: Micro-batches after which the states are written as one table again.
COMPACT_EVERY = 20


def _held(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Rows HELD with ``version``: those of the newest whole table, and of the batches after it."""
    found = [n for n in finished(spark, path) if before is None or int(n.split("-")[1]) < before]
    base = max((int(n.split("-")[1]) for n in found if n.startswith("base-")), default=-1)
    parts = [n for n in found if (n == f"base-{base}") or (n.startswith("batch-") and int(n.split("-")[1]) > base)]
    if not parts:
        return spark.createDataFrame([], f"{HELD}, version bigint")
    return spark.read.schema(f"{HELD}, version bigint").parquet(*[f"{path}/{n}" for n in parts])


def _latest(versions: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("state", "accepted", "total"), "version")
    return versions.groupBy("entity").agg(newest.alias("s")).select("entity", "s.*")


def states(spark: SparkSession, path: str, workflow: Workflow) -> DataFrame:
    """The current states (entity, state, accepted, rejected) that ``write_states`` keeps under ``path``."""
    return described(_latest(_held(spark, path)), workflow)


def advance_states(batch: DataFrame, number: int, workflow: Workflow, path: str, compact_every: int = COMPACT_EVERY) -> None:
    """One micro-batch: its events as stretches, chained onto the held states, written as one more version.

    Events are range partitioned by (entity, time), so an entity with a third of them is many stretches,
    a bounded one each. A version is read once its folder is complete, and a batch that is repeated after
    a failure starts from the versions before it and replaces its own.
    """
    spark = batch.sparkSession
    folded = run_dir(spark, "stretches")
    stretches(batch, workflow).write.parquet(folded)
    fresh = spark.read.parquet(folded)
    touched = fresh.select(F.col("entity").alias("_entity")).distinct()
    mine = _held(spark, path, number).join(touched, F.col("entity").eqNullSafe(F.col("_entity")), "left_semi")
    after = continued(_latest(mine), fresh, workflow).withColumn("version", F.lit(number).cast("bigint"))
    after.write.mode("overwrite").parquet(f"{path}/batch-{number}")
    removed(spark, folded)
    if (number + 1) % compact_every == 0:
        before = finished(spark, path)
        whole = _latest(_held(spark, path)).withColumn("version", F.lit(number).cast("bigint"))
        whole.write.mode("overwrite").parquet(f"{path}/base-{number}")
        # What the table before this one needed goes; its own parts stay for those who still read it.
        last = max((int(n.split("-")[1]) for n in before if n.startswith("base-") and n != f"base-{number}"), default=-1)
        for name in before:
            if int(name.split("-")[1]) < last or name == f"batch-{last}":
                removed(spark, f"{path}/{name}")


def write_states(log: DataFrame, workflow: Workflow, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Replay a stream of events (entity, event, ts, event_id) and keep the states under ``path``.

    Within a micro-batch the events of an entity are ordered by (ts, event_id); events that arrive in a
    later batch come later.
    """
    advance = lambda batch, number: advance_states(batch, number, workflow, path, compact_every)
    return log.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
