"""Spark-first document analytics: operators."""
