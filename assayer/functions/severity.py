"""Severity order and the labels alert targets use for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
COLOR = {
    "critical": "#FF0000",
    "high": "#FF6600",
    "medium": "#FFCC00",
    "low": "#0066FF",
    "info": "#00CC00",
}
PAGERDUTY = {"critical": "critical", "high": "error", "medium": "warning", "low": "info", "info": "info"}
OPSGENIE = {"critical": "P1", "high": "P2", "medium": "P3", "low": "P4", "info": "P5"}
DEFAULT_COLOR = "#808080"
DEFAULT_PAGERDUTY = "info"
DEFAULT_OPSGENIE = "P5"


def _choose(col: Column, mapping: dict, default) -> Column:
    expr = F.lit(default)
    for key, value in mapping.items():
        expr = F.when(col == key, F.lit(value)).otherwise(expr)
    return expr


def rank(severity: Column) -> Column:
    """5 for critical down to 1 for info; 0 for an unknown word."""
    return _choose(severity, RANK, 0)


def min_rank(severity: Column) -> Column:
    """The lowest rank a channel accepts; an unknown word accepts everything from info up."""
    return F.greatest(rank(severity), F.lit(1))


def meets_threshold(alert: Column, channel_min: Column) -> Column:
    return rank(alert) >= min_rank(channel_min)


def color(severity: Column) -> Column:
    return _choose(severity, COLOR, DEFAULT_COLOR)


def pagerduty(severity: Column) -> Column:
    return _choose(severity, PAGERDUTY, DEFAULT_PAGERDUTY)


def opsgenie(severity: Column) -> Column:
    return _choose(severity, OPSGENIE, DEFAULT_OPSGENIE)


def from_rank(value: Column) -> Column:
    return _choose(value, {v: k for k, v in RANK.items()}, None)
