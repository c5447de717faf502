"""Many checks as few scans: one lazy DataFrame with a result row per check."""

from __future__ import annotations

import time
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.checks import Verdict, check_type, status_of
from assayer.plans.catalog import Catalog
from assayer.plans.shared import shared_views
from assayer.session import removed, run_dir
from assayer.sources import history
from assayer.sources.sinks import write_results
from assayer.specs import CheckSpec, SpecError

# Checks per aggregate. Wider ones outgrow what the JVM compiles well: 64 checks over 12 million
# rows took a third less time in groups of 16 than in one aggregate.
FUSE_LIMIT = 16

RESULT_FIELDS = {
    "check_id": "string",
    "check_name": "string",
    "check_type": "string",
    "table_name": "string",
    "column_name": "string",
    "severity": "string",
    "status": "string",
    "actual_value": "double",
    "expected_value": "double",
    "actual_text": "string",
    "expected_text": "string",
    "details": "map<string,string>",
    "message": "string",
    "error": "string",
    "executed_at": "timestamp",
    "tenant_id": "string",
    "datasource_id": "string",
    "stored": "boolean",
}


#: Type of a listed check that does not exist.
MISSING = "missing"


def select_checks(
    specs: Iterable[CheckSpec], tenant_id: str = "", datasource_id: str = "", check_ids: Iterable[str] = ()
) -> list[CheckSpec]:
    """Checks of a datasource (or all, when it is empty), else the listed ones, in list order.

    A listed id without a check stays in the list; its result is an ``error`` row.
    """
    specs = list(specs)
    if check_ids and not datasource_id:
        by_id = {s.id: s for s in specs}
        return [by_id.get(i) or CheckSpec(i, MISSING, tenant_id=tenant_id) for i in check_ids]
    return [
        s
        for s in specs
        if (not tenant_id or s.tenant_id == tenant_id) and (not datasource_id or s.datasource_id == datasource_id)
    ]


def _constants(spark: SparkSession, specs: list[CheckSpec], fixed: dict[int, tuple[str, str | None]]) -> DataFrame:
    """What is known of every check without reading data: one local row per check.

    ``fixed`` holds the status and error of checks that are not run.
    """
    rows = []
    for i, s in enumerate(specs):
        status, error = fixed.get(i, (None, None))
        message = "check is inactive" if status == "skipped" else error and f"check execution failed: {error}"
        rows.append(
            {
                "idx": i, "check_id": s.id, "check_name": s.name or s.id, "check_type": s.type, "table_name": s.target,
                "column_name": s.column, "severity": s.severity, "tenant_id": s.tenant_id, "datasource_id": s.datasource_id,
                "stored": status != "skipped", "fixed_status": status, "fixed_error": error, "fixed_message": message,
            }
        )
    text = [n for n in rows[0] if n not in ("idx", "stored")]
    schema = pa.schema([("idx", pa.int32()), ("stored", pa.bool_()), *[(n, pa.string()) for n in text]])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema))


def _measured(idx: int, report: dict[str, str], spec: CheckSpec, verdict: Verdict) -> Column:
    """The part of a result that depends on data. ``report`` maps metric names to columns."""
    status, error = status_of(spec, verdict)
    none = F.lit(None)
    details = ", ".join(f"'{name}', string(`{column}`)" for name, column in report.items())
    values = [
        ("idx", F.lit(idx)),
        ("status", status),
        ("actual_value", verdict.actual),
        ("expected_value", verdict.expected),
        ("actual_text", verdict.actual_text),
        ("expected_text", verdict.expected_text),
        ("details", F.expr(f"map({details})")),
        ("message", verdict.message),
        ("error", error),
    ]
    return F.named_struct(*[x for name, col in values for x in (F.lit(name), none if col is None else col)])


MEASURED = (
    "array<struct<idx:int,status:string,actual_value:double,expected_value:double,actual_text:string,"
    "expected_text:string,details:map<string,string>,message:string,error:string>>"
)


def _rows(frame: DataFrame, structs: list[Column]) -> DataFrame:
    return frame.select(F.inline(F.array(*structs).cast(MEASURED)))


def suite(specs: Iterable[CheckSpec], catalog: Catalog, executed_at: str | None = None) -> DataFrame:
    """Results of all checks, in one DataFrame that runs as one job.

    Checks over the same table that are plain aggregates share one scan, or one per
    FUSE_LIMIT checks with each column read by as few of them as possible. Each distinct,
    referential and distribution check has an aggregation of its own, because several
    distinct sets in one aggregate multiply its input. A check that cannot be planned
    becomes an ``error`` row and leaves the others alone; an inactive one is ``skipped``.
    """
    specs = list(specs)
    if not specs:
        raise SpecError("no checks given")
    spark, ctx = catalog.spark, catalog.context()
    parts: list[DataFrame] = []
    fixed: dict[int, tuple[str, str | None]] = {}
    by_target: dict[str, list[_Planned]] = {}
    for i, spec in enumerate(specs):
        if not spec.active:
            fixed[i] = ("skipped", None)
            continue
        if spec.type == MISSING:
            fixed[i] = ("error", "check not found")
            continue
        try:
            kind = check_type(spec.type)
            target = catalog.resolve(spec.target) if spec.target or spec.type != "custom_sql" else None
            kind.validate(spec, target)
            if kind.shares_scan(spec):
                by_target.setdefault(spec.target, []).append(_Planned(i, spec, kind.aggregates(spec, target)))
            else:
                metrics = kind.frame(spec, target, ctx)
                one = _Planned(i, spec, {n: None for n in metrics.columns}, prefix="")
                parts.append(_rows(metrics.select(*one.report_columns()), [one.result()]))
        except (SpecError, PySparkException) as exc:
            fixed[i] = ("error", str(exc).splitlines()[0])
    for name, members in by_target.items():
        target = catalog.resolve(name)
        # Checks of one column stay together, so that groups read different columns.
        members.sort(key=lambda one: one.spec.column or "")
        for start in range(0, len(members), FUSE_LIMIT):
            group = members[start : start + FUSE_LIMIT]
            metrics = target.agg(*[col.alias(n) for one in group for n, col in one.metric_columns()])
            reports = metrics.select(*[col for one in group for col in one.report_columns()])
            parts.append(_rows(reports, [one.result() for one in group]))
    return _complete(spark, specs, fixed, parts, executed_at)


class _Planned:
    """One check on its way through a shared plan, its columns kept apart by a prefix."""

    def __init__(self, idx: int, spec: CheckSpec, aggregates: dict, prefix: str | None = None):
        self.idx, self.spec, self.kind, self.aggregates = idx, spec, check_type(spec.type), aggregates
        self.prefix = f"m{idx}_" if prefix is None else prefix
        self._report = self.kind.report(spec, {n: F.col(self.prefix + n) for n in aggregates})
        # Built now, so that a bad threshold shows before the plans are merged.
        columns = {n: F.col(self._name(n)) for n in self._report}
        self._result = _measured(idx, {n: self._name(n) for n in self._report}, spec, self.kind.judge(spec, columns))

    def _name(self, metric: str) -> str:
        return f"r{self.idx}_{metric}"

    def metric_columns(self) -> list[tuple[str, Column]]:
        return [(self.prefix + n, col) for n, col in self.aggregates.items()]

    def report_columns(self) -> list[Column]:
        return [col.alias(self._name(n)) for n, col in self._report.items()]

    def result(self) -> Column:
        return self._result


def _complete(
    spark: SparkSession, specs: list[CheckSpec], fixed: dict, parts: list[DataFrame], executed_at: str | None
) -> DataFrame:
    """Measured rows joined to what is known of each check, plus the checks that did not run.

    The constants are one row per check of a list that lives in the driver anyway, so
    broadcasting them is bounded.
    """
    now = F.lit(executed_at).cast("timestamp") if executed_at else F.current_timestamp()
    known = _constants(spark, specs, fixed)

    def shaped(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        columns = {**columns, "executed_at": now}
        return df.select(*[columns.get(n, F.col(n)).cast(t).alias(n) for n, t in RESULT_FIELDS.items()])

    out = []
    if parts:
        out.append(shaped(reduce(DataFrame.union, parts).join(F.broadcast(known), "idx"), {}))
    if fixed:
        unknown = dict.fromkeys(("actual_value", "expected_value", "actual_text", "expected_text", "details"), F.lit(None))
        stated = {n: F.col(f"fixed_{n}") for n in ("status", "message", "error")}
        out.append(shaped(known.where(F.col("fixed_status").isNotNull()), {**unknown, **stated}))
    return reduce(DataFrame.union, out)


def execute(
    specs: Iterable[CheckSpec], catalog: Catalog, path: str, run_id: str, executed_at: str | None = None
) -> DataFrame:
    """Run a suite and keep its results as a table under ``path``; returns the rows of this run.

    The suite runs as one job. When that breaks on the data (a corrupt file, a cast that raises
    inside custom SQL), the checks are halved until the broken ones are alone, and only those
    turn into ``error`` rows. Errors while writing the results are raised. A repeated run id
    replaces its rows. Views that several parts of the suite read are computed once.
    """
    store(specs, catalog, path, run_id, executed_at)
    return results(catalog.spark, path, run_id).drop("run_date")


def results(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The kept results under ``path``, of all runs or one, folded or not; ``run_date`` prunes."""
    return history.read_history(spark, path, _kept_schema(), run_id)


def compact_results(spark: SparkSession, path: str, fold: int = history.FOLD, merge: int = history.MERGE) -> bool:
    """Fold the small files of runs under ``path`` once there are ``fold`` runs; see ``sources.history``."""
    return history.compact(spark, path, _kept_schema(), fold, merge)


def store(specs: Iterable[CheckSpec], catalog: Catalog, path: str, run_id: str, executed_at: str | None = None) -> None:
    """``execute`` without reading the result table, which keeps old runs."""
    specs, started = list(specs), time.time()
    stage = run_dir(catalog.spark, "suite")
    try:
        with shared_views(specs, catalog, FUSE_LIMIT) as tables:
            _stored(specs, tables, executed_at, stage)
        rows = catalog.spark.read.schema(_result_schema()).parquet(stage)
        write_results(rows, path, run_id, started)
    finally:
        removed(catalog.spark, stage)


def _result_schema() -> str:
    return ", ".join(f"{n} {t}" for n, t in RESULT_FIELDS.items())


def _kept_schema() -> str:
    return ", ".join(f"{n} {t}" for n, t in RESULT_FIELDS.items() if n != "stored")


def _stored(specs: list[CheckSpec], catalog: Catalog, executed_at: str | None, stage: str) -> None:
    """Append the results of the checks to the stage, halving them where the job breaks."""
    part = run_dir(catalog.spark, "part")
    try:
        suite(specs, catalog, executed_at).write.parquet(part)
    except PySparkException as exc:
        if len(specs) > 1:
            middle = len(specs) // 2
            _stored(specs[:middle], catalog, executed_at, stage)
            _stored(specs[middle:], catalog, executed_at, stage)
            return
        reason = {0: ("error", str(exc).splitlines()[0])}
        _complete(catalog.spark, specs, reason, [], executed_at).write.mode("append").parquet(stage)
        return
    catalog.spark.read.schema(_result_schema()).parquet(part).coalesce(1).write.mode("append").parquet(stage)
    removed(catalog.spark, part)
