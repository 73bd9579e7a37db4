"""Spark-native analytics for partially labelled, multi-label tables."""
