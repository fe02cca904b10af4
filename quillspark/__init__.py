"""Spark-native analytics for scholarly-literature data."""
