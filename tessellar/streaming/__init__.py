"""Spark-first document analytics: streaming."""
