"""Data quality checks, logical views and governance tables as Spark jobs."""

from assayer.specs import (
    ChannelSpec,
    CheckParameters,
    CheckSpec,
    ColumnInfo,
    FilterDef,
    JoinDef,
    OrderByDef,
    ScheduleSpec,
    SelectDef,
    SourceSpec,
    SpecError,
    Threshold,
    ViewDefinition,
    ViewSpec,
)

__all__ = [
    "ChannelSpec",
    "CheckParameters",
    "CheckSpec",
    "ColumnInfo",
    "FilterDef",
    "JoinDef",
    "OrderByDef",
    "ScheduleSpec",
    "SelectDef",
    "SourceSpec",
    "SpecError",
    "Threshold",
    "ViewDefinition",
    "ViewSpec",
]
