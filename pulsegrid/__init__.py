"""Spark-native physiological time-series analytics."""
