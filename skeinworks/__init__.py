"""Spark-native sync, retrieval and corpus analytics."""
