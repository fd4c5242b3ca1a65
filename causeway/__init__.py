"""Spark-native incident and log analytics."""
