"""Registered queries."""

from stockcount.plans import q_catalog, q_count, q_detect, q_harvest, q_match, q_process, q_review, q_runs, q_stream, q_track  # noqa: F401
from stockcount.plans.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
