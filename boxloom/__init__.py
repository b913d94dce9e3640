"""Spark-native analytics for detection annotations."""
