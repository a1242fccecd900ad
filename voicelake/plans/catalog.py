"""Imports every query module, so that the registry is complete."""

from voicelake.plans import audit_queries, function_queries, graph_queries, join_queries, score_queries, select_queries, signal_queries, source_queries, stat_queries, stream_queries  # noqa: F401
from voicelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
