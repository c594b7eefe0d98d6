"""All registered queries."""

from tidemark.plans import flow_queries, indicator_queries, join_queries, ml_queries, projection_queries, search_queries, signal_queries, source_queries, stat_queries, stream_queries, trade_queries, window_queries  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
