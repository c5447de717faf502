"""Names to DataFrames: base tables and logical views, compiled on first use."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.expressions import count_rows
from assayer.operators.checks import Context
from assayer.plans.views import compile_view
from assayer.specs import SpecError, ViewSpec

Table = DataFrame | Callable[[], DataFrame]


class Catalog:
    """Tables and views of one session. All of it is lazy: no job runs here."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Table] | None = None, views: Iterable[ViewSpec] = ()):
        self.spark = spark
        self._tables = dict(tables or {})
        self._views: dict[str, ViewSpec] = {}
        self._frames: dict[str, DataFrame] = {}
        self._open: list[str] = []
        for view in views:
            self.add_view(view)

    def add_table(self, name: str, table: Table) -> None:
        self._tables[name] = table
        self._frames.clear()

    def add_view(self, view: ViewSpec) -> None:
        for name in {view.id, view.view_name}:
            self._views[name] = view
            self._frames.clear()

    def table_names(self) -> list[str]:
        return sorted(self._tables)

    def view_specs(self) -> list[ViewSpec]:
        return list({v.id: v for v in self._views.values()}.values())

    def replaced(self, view: ViewSpec, frame: DataFrame) -> Catalog:
        """A catalog in which the view is the given table, under its id and its name."""
        names = {view.id, view.view_name}
        tables = {**self._tables, **dict.fromkeys(names, frame)}
        return Catalog(self.spark, tables, [v for v in self.view_specs() if v.id != view.id])

    def resolve(self, name: str) -> DataFrame:
        """The DataFrame behind a view or table name."""
        if name in self._frames:
            return self._frames[name]
        if name in self._open:
            raise SpecError(f"view cycle: {' -> '.join([*self._open, name])}")
        self._open.append(name)
        try:
            if name in self._views:
                frame = compile_view(self._views[name].definition, self)
            elif name in self._tables:
                table = self._tables[name]
                frame = table if isinstance(table, DataFrame) else table()
            else:
                try:
                    frame = self.spark.table(name)
                except AnalysisException as exc:
                    raise SpecError(f"unknown table or view '{name}'") from exc
        finally:
            self._open.pop()
        self._frames[name] = frame
        return frame

    def sql(self, text: str, extra: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """Spark SQL over the catalog: its names win over what the session already knows.

        Every catalog name that occurs in the text, in any case as Spark reads names, is bound
        for the time of analysis, so a view left behind by another catalog is never read. What
        the session had under these names is put back afterwards. A name that only looks like a
        table (a column, a word) may fail to bind without harm.
        """
        had: dict[str, DataFrame | None] = {}
        broken: dict[str, SpecError] = {}
        try:
            for name in [*self._tables, *self._views, *(extra or {})]:
                if "." in name or not re.search(rf"(?<!\w){re.escape(name)}(?!\w)", text, re.IGNORECASE):
                    continue
                if name.lower() not in had:
                    had[name.lower()] = self.spark.table(name) if self._is_temporary(name) else None
                try:
                    frame = (extra or {}).get(name)
                    (self.resolve(name) if frame is None else frame).createOrReplaceTempView(name)
                except SpecError as exc:
                    broken[name.lower()] = exc
                    self.spark.catalog.dropTempView(name)
            return self.spark.sql(text)
        except AnalysisException as exc:
            if exc.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                missing = exc.getMessageParameters()["relationName"].replace("`", "").lower()
                if missing in broken:
                    raise broken[missing] from exc  # says why it cannot be read
            raise
        finally:
            for name, frame in had.items():
                if frame is None:
                    self.spark.catalog.dropTempView(name)
                else:
                    frame.createOrReplaceTempView(name)

    def _is_temporary(self, name: str) -> bool:
        found = self.spark.sql("SHOW VIEWS LIKE '" + name.lower().replace("'", "") + "'").where("isTemporary")
        return not found.isEmpty()

    def register(self) -> None:
        """Register every table and view as a temporary view."""
        for name in [*self._tables, *self._views]:
            self.resolve(name).createOrReplaceTempView(name)

    def context(self) -> Context:
        return Context(self.spark, self.resolve, self.sql)

    # ---------------------------------------------------------------- reading a view

    def _view(self, name: str) -> ViewSpec:
        if name not in self._views:
            raise SpecError(f"view not found: {name}")
        return self._views[name]

    def query_view(self, name: str, limit: int = 0) -> DataFrame:
        """Rows of an active view, capped when a limit is asked for."""
        if not self._view(name).active:
            raise SpecError("view is inactive")
        frame = self.resolve(name)
        return frame.limit(limit) if limit > 0 else frame

    def count_view(self, name: str) -> DataFrame:
        self._view(name)
        return self.resolve(name).agg(count_rows().alias("row_count"))

    def view_schema(self, name: str) -> DataFrame:
        self._view(name)
        return describe(self.resolve(name))


def describe(df: DataFrame) -> DataFrame:
    """Columns of a table or view as rows; known from analysis, so nothing is scanned."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    schema = "position int, name string, data_type string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, schema).select(
        "position",
        "name",
        "data_type",
        "nullable",
        F.lit(None).cast("string").alias("default_value"),
        F.lit(False).alias("is_primary_key"),
        F.lit(None).cast("string").alias("description"),
    )
