"""Spark-native curation analytics."""
