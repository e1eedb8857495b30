"""Spark-first document analytics: functions."""
