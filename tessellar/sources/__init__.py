"""Spark-first document analytics: sources."""
