"""Queries over the given tables, and the SQL that they are compared with."""

from trackloom.plans import cluster_queries, flagship, model_queries, source_queries, space_queries, statistics_queries, table_queries, track_queries  # noqa: F401  they register themselves
from trackloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
