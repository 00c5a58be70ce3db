"""All registered queries."""

from . import graph_queries, label_queries, log_queries, profile_queries, score_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "label_queries", "log_queries", "profile_queries", "score_queries"]
