"""All registered queries of the library."""

from __future__ import annotations

from flowtally.plans import more_queries, packet_queries, report_queries, whole_queries  # noqa: F401
from flowtally.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
