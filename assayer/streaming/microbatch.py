"""A check suite on every micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from assayer.plans.catalog import Catalog
from assayer.plans.suite import compact_results, store
from assayer.sources.history import FOLD
from assayer.specs import CheckSpec


def run_on_stream(
    stream: DataFrame,
    table: str,
    specs: Iterable[CheckSpec],
    catalog: Catalog,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    executed_at: str | None = None,
    fold: int = FOLD,
) -> StreamingQuery:
    """Check each micro-batch as if it were ``table`` and append the results under ``path``.

    The batch id is the run id, and a repeated batch replaces its rows, so a restart does
    not count a batch twice. Reference tables still come from the catalog. After ``fold`` batches their
    files become one (0: never); ``plans.suite.results`` reads both.
    """
    specs = list(specs)

    def check(batch: DataFrame, batch_id: int) -> None:
        # A view over the table must see the batch, so the catalog is rebuilt around it.
        tables = {name: catalog.resolve(name) for name in catalog.table_names() if name != table}
        local = Catalog(batch.sparkSession, {**tables, table: batch}, catalog.view_specs())
        batch.persist()
        try:
            store(specs, local, path, f"batch-{batch_id}", executed_at)
        finally:
            batch.unpersist()
        if fold:
            compact_results(batch.sparkSession, path, fold)

    return (
        stream.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
