"""Spark-native analytics for social and web text."""
