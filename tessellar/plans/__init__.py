"""Spark-first document analytics: plans."""

from . import file_queries, index_queries, protocol_queries, queries  # each registers its queries

__all__ = ["file_queries", "index_queries", "protocol_queries", "queries"]
