"""The result table of years of schedules: run folders, folded into dated files under a manifest.

``write_results`` leaves one small folder per run, complete once it has its ``_SUCCESS``. ``compact`` folds
completed runs into one set of files by date, sorted by tenant and check, so that a date prunes folders and a
tenant row groups. Folds of a tier become one of the next tier when there are MERGE of them, so a row is
rewritten a logarithmic number of times. A manifest, written last and renamed into place, names the folds that
count and the run folders in them; ``read_history`` follows the newest. Until it is there nothing has changed
for a reader, and what it makes superfluous is only removed by the compaction after it.

A run that is repeated after it was folded leaves a fresh folder again, which replaces the folded rows. One
compaction may run at a time, beside any number of writers of different runs and readers.
"""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import finished, removed

#: Run folders that make a compaction worthwhile, and folds of a tier that become one.
FOLD, MERGE = 32, 8
FOLDS, MANIFESTS = "_folds", "_manifests"
WRITTEN = "started_at timestamp, run_id string"


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _run_folders(spark: SparkSession, path: str) -> dict[str, str]:
    """Folders of completed runs with the names of their files, which differ from one try of a run to the next."""
    tries = {}
    for name in finished(spark, path):
        if name.startswith("run_id="):
            files, place = _at(spark, f"{path}/{name}")
            tries[name] = " ".join(sorted(s.getPath().getName() for s in files.listStatus(place)))
    return tries


def _manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: number, folds {name: tier}, folded {run folder: its files}, replaced {run id: first fold that counts}."""
    files, place = _at(spark, f"{path}/{MANIFESTS}")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_"]
    if not numbers:
        return {"number": 0, "folds": {}, "folded": {}, "replaced": {}}
    stream = files.open(_at(spark, f"{path}/{MANIFESTS}/{max(numbers):010d}.json")[1])
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    name = f"{manifest['number']:010d}.json"
    files, draft = _at(spark, f"{path}/{MANIFESTS}/_{name}")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not files.rename(draft, _at(spark, f"{path}/{MANIFESTS}/{name}")[1]):
        raise RuntimeError(f"another compaction of {path} has written manifest {name}")


def _run_id(folder: str) -> str:
    return unquote(folder.removeprefix("run_id="))


def _runs(spark: SparkSession, path: str, folders: list[str], fields: str) -> DataFrame:
    """Rows of run folders; ``basePath`` makes the run id a column again."""
    rows = spark.read.schema(f"{fields}, {WRITTEN}").option("basePath", path).parquet(*[f"{path}/{n}" for n in folders])
    return rows.withColumn("run_date", F.to_date("started_at"))


def _folds(spark: SparkSession, path: str, folds: list[str], replaced: dict[str, int], fields: str) -> DataFrame:
    """Rows of folds without those of runs that a later fold replaced."""
    parts = []
    for name in folds:
        rows = spark.read.schema(f"{fields}, {WRITTEN}, run_date date").parquet(f"{path}/{FOLDS}/{name}")
        old = [run for run, first in replaced.items() if int(name) < first]
        parts.append(rows.where(~F.col("run_id").isin(old)) if old else rows)
    return reduce(DataFrame.union, parts)


def read_history(spark: SparkSession, path: str, fields: str, run_id: str | None = None) -> DataFrame:
    """Stored results of all runs, or of one, with ``run_date``. A table without runs has no rows.

    The driver holds the names of the run folders that are not folded yet.
    """
    manifest = _manifest(spark, path)
    runs = _run_folders(spark, path)
    fresh = [n for n, its in runs.items() if manifest["folded"].get(n) != its and run_id in (None, _run_id(n))]
    parts = [_runs(spark, path, fresh, fields)] if fresh else []
    if manifest["folds"] and not (run_id is not None and fresh):
        kept = _folds(spark, path, list(manifest["folds"]), manifest["replaced"], fields)
        if run_id is not None:
            kept = kept.where(F.col("run_id") == run_id)
        elif fresh:
            kept = kept.where(~F.col("run_id").isin([_run_id(n) for n in fresh]))
        parts.append(kept)
    if not parts:
        return spark.createDataFrame([], f"{fields}, {WRITTEN}, run_date date")
    return reduce(DataFrame.union, parts)


def _fold(rows: DataFrame, path: str, number: int) -> str:
    """Write rows as one more fold. A date is as many files as its rows need, small dates share a task."""
    name = f"{number:010d}"
    order = [c for c in ("run_date", "tenant_id", "check_id") if c in rows.columns]
    by_date = rows.hint("rebalance", "run_date").sortWithinPartitions(*order)
    by_date.write.mode("overwrite").partitionBy("run_date").parquet(f"{path}/{FOLDS}/{name}")
    return name


def compact(spark: SparkSession, path: str, fields: str, fold: int = FOLD, merge: int = MERGE) -> bool:
    """Fold the completed runs, once there are ``fold`` of them; True if it did.

    What the manifest before did without is removed now: readers that started from it have had a whole
    compaction's time to end.
    """
    manifest, runs = _manifest(spark, path), _run_folders(spark, path)
    fresh = {n: its for n, its in runs.items() if manifest["folded"].get(n) != its}
    if len(fresh) < max(1, fold):
        return False
    number, folds, replaced = manifest["number"] + 1, dict(manifest["folds"]), dict(manifest["replaced"])
    files, place = _at(spark, f"{path}/{FOLDS}")
    gone = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    for name in gone:
        if name not in folds:
            removed(spark, f"{path}/{FOLDS}/{name}")
    for name, its in manifest["folded"].items():
        if runs.get(name) == its:
            removed(spark, f"{path}/{name}")

    # Numbers only grow: a fold's number says which of two folds with the same run is the later one.
    first = 2 * number
    written = _fold(_runs(spark, path, sorted(fresh), fields), path, first)
    if folds:
        ids = [_run_id(n) for n in fresh]
        held = _folds(spark, path, list(folds), replaced, fields).where(F.col("run_id").isin(ids))
        replaced.update({r.run_id: first for r in held.select("run_id").distinct().collect()})  # of the runs folded now
    folds[written] = 0
    tier = 0
    while len(own := [n for n, t in folds.items() if t == tier]) >= merge:
        tier += 1
    if tier:
        # All tiers that are full go into one fold of the tier above, at one go.
        own = [n for n, t in folds.items() if t < tier]
        whole = _fold(_folds(spark, path, own, replaced, fields), path, first + 1)
        folds = {n: t for n, t in folds.items() if n not in own} | {whole: tier}
        oldest = min(map(int, folds))
        replaced = {run: later for run, later in replaced.items() if oldest < later}
    _write_manifest(spark, path, {"number": number, "folds": folds, "folded": fresh, "replaced": replaced})
    return True
