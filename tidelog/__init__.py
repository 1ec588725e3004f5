"""Spark-native key-value, log and distributed-data analytics."""
