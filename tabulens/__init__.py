"""Spark-native table profiling and corpus preparation."""
