"""Spark-native analytics for tabular evidence mining."""
