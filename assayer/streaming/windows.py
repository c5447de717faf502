"""Check metrics per event-time window."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.checks import Context, check_type, status_of
from assayer.plans.catalog import Catalog
from assayer.specs import CheckSpec, SpecError

#: Column that holds the window while keys are counted.
WINDOW = "checked_window"


def windowed_checks(
    events: DataFrame,
    specs: Iterable[CheckSpec],
    time_column: str,
    length: str,
    slide: str | None = None,
    lateness: str | None = None,
) -> DataFrame:
    """Metrics and status of scan-type checks per window: columns ``<check id>_<metric>``.

    Works on a stream and on a table alike. All checks share one aggregation; with
    ``lateness`` rows older than the watermark are left out and closed windows are final.
    """
    specs = list(specs)
    metrics, outputs = [], []
    for spec in specs:
        kind = check_type(spec.type)
        if not kind.fused:
            raise SpecError(f"{spec.type} is not a windowed check")
        kind.validate(spec, events)
        aggregates = kind.aggregates(spec, events)
        metrics += [col.alias(f"{spec.id}_{name}") for name, col in aggregates.items()]
        report = kind.report(spec, {n: F.col(f"{spec.id}_{n}") for n in aggregates})
        status, _ = status_of(spec, kind.judge(spec, report))
        outputs += [col.alias(f"{spec.id}_{name}") for name, col in report.items()]
        outputs.append(status.alias(f"{spec.id}_status"))
    if lateness:
        events = events.withWatermark(time_column, lateness)
    window = F.window(F.col(time_column), length, slide) if slide else F.window(F.col(time_column), length)
    grouped = events.groupBy(window.alias("w")).agg(*metrics)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *outputs)


#: Checks that count keys first: within a window as well as over a table.
KEYED = ("uniqueness", "referential_integrity", "distribution")


def windowed_keyed_check(
    events: DataFrame,
    spec: CheckSpec,
    time_column: str,
    length: str,
    slide: str | None = None,
    lateness: str | None = None,
    catalog: Catalog | None = None,
) -> DataFrame:
    """Metrics and status of one keyed check per window: exact distinct keys, orphans, or shares of values.

    Two levels of aggregation in event time: rows are counted by window and key, which spreads a
    window over all tasks and keeps one state row per key, then the counts by window. Works on a stream
    and on a table alike; a stream needs ``lateness``, and gives a window when both levels have closed it.

    The reference of a referential check comes from the catalog. A table holds for all windows, and a
    window's counted keys are joined to its counted keys. A stream must have the same time column and
    holds for the window its rows are in; both streams then meet in one aggregation by window and key.
    NULL keys and late rows are treated as in ``windowed_checks`` and the checks over tables.
    """
    if spec.type not in KEYED:
        raise SpecError(f"{spec.type} is not a keyed check")
    kind = check_type(spec.type)
    kind.validate(spec, events)
    if events.isStreaming and not lateness:
        raise SpecError("a keyed check over a stream needs a lateness, or its windows never close")

    def timed(df: DataFrame) -> DataFrame:
        late = df.withWatermark(time_column, lateness) if lateness else df
        window = F.window(F.col(time_column), length, slide) if slide else F.window(F.col(time_column), length)
        return late.withColumn(WINDOW, window)

    def resolved(name: str) -> DataFrame:
        found = catalog.resolve(name)
        return timed(found) if found.isStreaming else found

    context = Context(events.sparkSession, resolved if catalog else None, None)
    metrics = kind.frame(spec, timed(events), context, by=(WINDOW,))
    report = kind.report(spec, {n: F.col(n) for n in metrics.columns if n != WINDOW})
    flat = metrics.select(F.col(f"{WINDOW}.start").alias("window_start"), F.col(f"{WINDOW}.end").alias("window_end"), *[c.alias(n) for n, c in report.items()])
    status, _ = status_of(spec, kind.judge(spec, {n: F.col(n) for n in report}))
    return flat.withColumn("status", status)


def write_windows(windows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append closed windows to a Parquet table."""
    return (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
