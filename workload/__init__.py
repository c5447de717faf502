"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from workload import checks, governance, lineage, results, sources, streaming, views, workflow  # noqa: F401
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
