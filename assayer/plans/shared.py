"""Views that several parts of a suite read: computed once, read from files by all of them.

A part is what a suite plans by itself: a group of fused checks on one target, or a check with an
aggregation of its own. A view is written when the suite would compute it at least twice and computing
it takes more than reading and filtering. Views below it count once for each time they are computed, so a
view under two views that are written is written as well, and one under a single written view is not.

Only the columns that checks read are written, unless something else (SQL text, another view, a check of
the schema) reads the view too. A view that cannot be planned or written stays a view, so that its checks
fail or err by themselves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from assayer.operators.checks import check_type
from assayer.plans.catalog import Catalog
from assayer.session import removed, run_dir
from assayer.specs import CheckSpec, SpecError, ViewDefinition, ViewSpec

LEAST_USES = 2
#: Checks whose columns are all named by their specification.
BY_COLUMN = frozenset(
    "row_count null_check uniqueness freshness min_value max_value mean_value sum_value std_dev regex format range set_membership "
    "referential_integrity volume distribution".split()
)


def costly(definition: ViewDefinition) -> bool:
    """Whether a view does more than read and filter."""
    d = definition
    return bool(d.sql or d.joins or d.group_by or d.order_by or d.limit or (d.union_tables and not d.union_all))


def _named_in(text: str, names: Iterable[str]) -> set[str]:
    return {n for n in names if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.IGNORECASE)}


def _read_by(definition: ViewDefinition, names: Iterable[str]) -> Counter[str]:
    """How often a view's definition names each of the given views."""
    if definition.sql:
        return Counter(_named_in(definition.sql, names))
    tables = [definition.base_table, *[j.table for j in definition.joins], *definition.union_tables]
    return Counter(t.split()[0] for t in tables if t and t.split()[0] in set(names))


class Uses:
    """How often a suite reads each view, and which of its columns."""

    def __init__(self, specs: Iterable[CheckSpec], views: list[ViewSpec], fuse_limit: int):
        self.views = views
        self.ids = {name: v.id for v in views for name in (v.id, v.view_name)}
        self.times: Counter[str] = Counter()
        self.columns: dict[str, set[str] | None] = {}
        fused: Counter[str] = Counter()
        for spec in specs:
            if not spec.active:
                continue
            try:
                shares = check_type(spec.type).shares_scan(spec)
            except SpecError:
                continue
            p = spec.parameters
            if spec.type in BY_COLUMN:
                if spec.target in self.ids:
                    own = {spec.column, p.timestamp_column, *p.unique_columns} - {None, ""}
                    self._add(spec.target, 0 if shares else 1, own)
                if p.reference_table in self.ids:
                    self._add(p.reference_table, 1, {p.reference_column or ""})
            else:
                named = _named_in(p.custom_sql or "", self.ids) | ({spec.target} & set(self.ids))
                for name in {self.ids[n]: n for n in named}.values():
                    self._add(name, 0 if shares else 1, None)
            if shares and spec.target in self.ids:
                fused[self.ids[spec.target]] += 1
        for name, checks in fused.items():
            self.times[name] += math.ceil(checks / fuse_limit)

    def _add(self, name: str, times: int, columns: set[str] | None) -> None:
        view = self.ids[name]
        self.times[view] += times
        known = self.columns.setdefault(view, set())
        self.columns[view] = None if columns is None or known is None else known | columns

    def worth_writing(self) -> list[ViewSpec]:
        """Views to write, those that others read first."""
        order, times = self._outermost_first(), Counter(self.times)
        chosen = []
        for view in order:
            write = times[view.id] >= LEAST_USES and costly(view.definition)
            if write:
                chosen.append(view)
            computed = 1 if write else times[view.id]
            for name, count in _read_by(view.definition, self.ids).items():
                below = self.ids[name]
                times[below] += computed * count
                if computed:
                    self.columns[below] = None
        return chosen[::-1]

    def _outermost_first(self) -> list[ViewSpec]:
        by_id, done, order = {v.id: v for v in self.views}, set(), []

        def visit(view: ViewSpec) -> None:
            if view.id in done:  # also ends cycles, which the catalog reports
                return
            done.add(view.id)
            for name in _read_by(view.definition, self.ids):
                visit(by_id[self.ids[name]])
            order.append(view)

        for view in self.views:
            visit(view)
        return order[::-1]


def _pruned(frame: DataFrame, columns: set[str] | None) -> DataFrame:
    """Only the named columns, if all of them are plain columns of the frame; at least one stays to count rows."""
    if columns is None or not columns <= set(frame.columns):
        return frame
    return frame.select(*[c for c in frame.columns if c in columns] or frame.columns[:1])


@contextmanager
def shared_views(specs: Iterable[CheckSpec], catalog: Catalog, fuse_limit: int) -> Iterator[Catalog]:
    """A catalog that reads the views worth writing from files, which are removed at the end."""
    uses = Uses(specs, catalog.view_specs(), fuse_limit)
    tables, paths = catalog, []
    try:
        for view in uses.worth_writing():
            path = run_dir(catalog.spark, f"view-{re.sub(r'[^A-Za-z0-9]', '_', view.id)}")
            paths.append(path)
            try:
                frame = _pruned(tables.resolve(view.id), uses.columns.get(view.id))
                frame.write.parquet(path)
                written = catalog.spark.read.schema(frame.schema).parquet(path)
            except (SpecError, PySparkException):
                continue
            tables = tables.replaced(view, written)
        yield tables
    finally:
        for path in paths:
            removed(catalog.spark, path)
