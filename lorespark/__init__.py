"""Spark-native knowledge retrieval and usage-analytics engine."""
