"""Declarative inputs: what to check, which view, which source, whom to alert.

Specs are plain frozen values. They hold no Spark objects, so they can be built
from JSON, stored in a table, or written by hand.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any


class SpecError(ValueError):
    """A spec that cannot be turned into a Spark plan."""


CHECK_STATUSES = ("pending", "running", "passed", "failed", "warning", "error", "skipped")
SEVERITIES = ("critical", "high", "medium", "low", "info")
THRESHOLD_OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "between")
FILTER_OPERATORS = (
    "eq", "ne", "lt", "lte", "gt", "gte", "in", "not_in", "like", "is_null", "is_not_null",
)
JOIN_TYPES = ("inner", "left", "right", "full", "cross")


def _from_dict(cls, data: dict, nested: dict[str, Any] | None = None):
    names = {f.name for f in dataclasses.fields(cls)}
    unknown = set(data) - names
    if unknown:
        raise SpecError(f"{cls.__name__}: unknown fields {sorted(unknown)}")
    values = dict(data)
    for name, build in (nested or {}).items():
        if name in values and isinstance(values[name], (dict, list, tuple)):
            values[name] = build(values[name])
    return cls(**values)


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    data_type: str = ""
    nullable: bool = True
    default_value: str | None = None
    is_primary_key: bool = False
    description: str | None = None


@dataclass(frozen=True)
class Threshold:
    """Pass criterion. An ``operator`` replaces the default verdict of the check type."""

    type: str = "absolute"
    value: float = 0.0
    min_value: float | None = None
    max_value: float | None = None
    operator: str | None = None


@dataclass(frozen=True)
class CheckParameters:
    min_rows: int | None = None
    max_rows: int | None = None
    max_null_percentage: float | None = None
    max_null_count: int | None = None
    unique_columns: tuple[str, ...] = ()
    allow_nulls: bool = True
    max_age_hours: float | None = None
    timestamp_column: str | None = None
    as_of: str | None = None
    custom_sql: str | None = None
    expected_value: str | None = None
    count_rows: bool = False
    expected_min: float | None = None
    expected_max: float | None = None
    expected_mean: float | None = None
    tolerance: float = 0.0
    pattern: str | None = None
    format: str | None = None
    allowed_values: tuple[str, ...] = ()
    reference_table: str | None = None
    reference_column: str | None = None
    count_mode: str = "joined"
    expected_volume: int | None = None
    volume_tolerance: float = 0.0
    grain: str | None = None
    expected_distribution: dict[str, float] | None = None
    expected_schema: tuple[ColumnInfo, ...] = ()
    expected_columns: int | None = None
    fail_on_extra: bool = False
    # An explicit 0 is a real limit instead of "unset".
    strict_zero: bool = False

    def __post_init__(self):
        for name in ("unique_columns", "allowed_values"):
            object.__setattr__(self, name, tuple(getattr(self, name) or ()))
        object.__setattr__(
            self,
            "expected_schema",
            tuple(c if isinstance(c, ColumnInfo) else _from_dict(ColumnInfo, c) for c in self.expected_schema or ()),
        )

    def limit(self, name: str):
        """The numeric limit, or None when it is unset (0 counts as unset unless strict)."""
        value = getattr(self, name)
        if value is None:
            return None
        if self.strict_zero:
            return value
        return value if value > 0 else None


@dataclass(frozen=True)
class CheckSpec:
    id: str
    type: str
    table: str = ""
    column: str | None = None
    name: str = ""
    tenant_id: str = ""
    datasource_id: str = ""
    description: str = ""
    parameters: CheckParameters = field(default_factory=CheckParameters)
    threshold: Threshold = field(default_factory=Threshold)
    warn_threshold: float | None = None
    severity: str = "medium"
    tags: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)
    active: bool = True
    schedule_id: str | None = None
    view_id: str | None = None

    @staticmethod
    def from_dict(data: dict) -> CheckSpec:
        return _from_dict(
            CheckSpec,
            data,
            {
                "parameters": lambda v: _from_dict(CheckParameters, v),
                "threshold": lambda v: _from_dict(Threshold, v),
                "tags": tuple,
            },
        )

    @property
    def target(self) -> str:
        """Name of the table or view the check reads; a bound view wins."""
        return self.view_id or self.table


@dataclass(frozen=True)
class SelectDef:
    """One output column: an SQL expression, a source column, or a plain name, in that order."""

    name: str = ""
    expression: str | None = None
    source_column: str | None = None
    alias: str | None = None
    data_type: str | None = None


@dataclass(frozen=True)
class FilterDef:
    column: str
    operator: str
    value: Any = None
    values: tuple = ()
    logical_op: str = ""

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values or ()))


@dataclass(frozen=True)
class JoinDef:
    """``on_columns`` is a flat list of pairs [left1, right1, left2, right2, ...].

    ``skew_share`` > 0 salts the keys that hold at least that share of the rows.
    """

    table: str
    type: str
    on_columns: tuple[str, ...] = ()
    on_condition: str | None = None
    skew_share: float = 0.0

    def __post_init__(self):
        object.__setattr__(self, "on_columns", tuple(self.on_columns or ()))


@dataclass(frozen=True)
class OrderByDef:
    column: str
    direction: str = ""


@dataclass(frozen=True)
class ViewDefinition:
    sql: str | None = None
    base_table: str | None = None
    columns: tuple[SelectDef, ...] = ()
    filters: tuple[FilterDef, ...] = ()
    joins: tuple[JoinDef, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[OrderByDef, ...] = ()
    limit: int = 0
    union_tables: tuple[str, ...] = ()
    union_all: bool = False

    def __post_init__(self):
        for name, cls in (("columns", SelectDef), ("filters", FilterDef), ("joins", JoinDef), ("order_by", OrderByDef)):
            items = tuple(i if isinstance(i, cls) else _from_dict(cls, i) for i in getattr(self, name) or ())
            object.__setattr__(self, name, items)
        for name in ("group_by", "union_tables"):
            object.__setattr__(self, name, tuple(getattr(self, name) or ()))


@dataclass(frozen=True)
class ViewSpec:
    id: str
    definition: ViewDefinition
    name: str = ""
    tenant_id: str = ""
    datasource_id: str = ""
    description: str = ""
    tags: tuple[str, ...] = ()
    metadata: dict[str, str] = field(default_factory=dict)
    active: bool = True

    @staticmethod
    def from_dict(data: dict) -> ViewSpec:
        return _from_dict(
            ViewSpec, data, {"definition": lambda v: _from_dict(ViewDefinition, v), "tags": tuple}
        )

    @property
    def view_name(self) -> str:
        return self.name or self.id


@dataclass(frozen=True)
class SourceSpec:
    """A place tables come from: files, a lakehouse, a database over JDBC, or a warehouse."""

    id: str
    type: str
    tenant_id: str = ""
    name: str = ""
    path: str = ""
    format: str | None = None
    host: str = ""
    port: int | None = None
    database: str = ""
    schema: str = ""
    username: str = ""
    password: str = ""
    ssl_mode: str = ""
    account: str = ""
    warehouse: str = ""
    catalog: str = ""
    project_id: str = ""
    dataset: str = ""
    http_path: str = ""
    token: str = ""
    key_file: str = ""
    private_key: str = ""
    connection_url: str = ""
    bucket: str = ""
    region: str = ""
    access_key: str = ""
    secret_key: str = ""
    endpoint: str = ""
    options: dict[str, str] = field(default_factory=dict)
    active: bool = True


@dataclass(frozen=True)
class ScheduleSpec:
    id: str
    name: str = ""
    tenant_id: str = ""
    cron_expression: str = ""
    timezone: str = "UTC"
    check_ids: tuple[str, ...] = ()
    datasource_id: str = ""
    alert_channel_ids: tuple[str, ...] = ()
    active: bool = True


@dataclass(frozen=True)
class ChannelSpec:
    id: str
    type: str
    name: str = ""
    tenant_id: str = ""
    min_severity: str = "info"
    active: bool = True
    configuration: dict[str, str] = field(default_factory=dict)
