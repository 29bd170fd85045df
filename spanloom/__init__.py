"""Spark-native analytics for annotated comment threads."""
