"""Spark-native analytics for operational logs."""
