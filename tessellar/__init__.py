"""Spark-first document analytics: package."""
