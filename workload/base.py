"""Registry of queries and access to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from assayer.operators.checks import measure
from assayer.plans.catalog import Catalog
from assayer.specs import CheckParameters, CheckSpec, SelectDef, Threshold, ViewDefinition, ViewSpec

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what it must equal on the same tables."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is inferred once, as a metastore would keep it."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def catalog(spark: SparkSession, sf_dir: str, *views: ViewSpec) -> Catalog:
    """The given tables plus views; a table is opened when it is first used."""
    return Catalog(spark, {n: (lambda n=n: table(spark, sf_dir, n)) for n in TABLES}, views)


def check(name: str, spec: CheckSpec, sql: str | None = None, views: tuple[ViewSpec, ...] = ()) -> None:
    """Register one check in its flat form: metrics and status."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = catalog(spark, sf_dir, *views)
        target = tables.resolve(spec.target) if spec.target else None
        return measure(spec, target, tables.context())


def view_query(name: str, definition: ViewDefinition, sql: str | None = None, views: tuple[ViewSpec, ...] = ()) -> None:
    """Register the rows of a logical view."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = catalog(spark, sf_dir, *views, ViewSpec(name, definition))
        return tables.query_view(name)


def spec(id: str, type: str, table: str = "", column: str | None = None, **options) -> CheckSpec:
    """Shorthand: check fields by name, everything else is a parameter."""
    fields = {k: options.pop(k) for k in list(options) if k in CheckSpec.__dataclass_fields__}
    return CheckSpec(id, type, table, column, parameters=CheckParameters(**options), **fields)


DOCUMENT_LABELS = ViewSpec(
    "document_labels",
    ViewDefinition(
        base_table="documents d",
        joins=[{"table": "labels l", "type": "left", "on_columns": ["d.doc_id", "l.doc_id"]}],
        columns=[
            SelectDef("d.doc_id"),
            SelectDef("lang"),
            SelectDef("source"),
            SelectDef("quality"),
            SelectDef("toxic"),
        ],
    ),
)

__all__ = ["CheckSpec", "Threshold", "ViewSpec", "ViewDefinition", "SelectDef", "DOCUMENT_LABELS"]
