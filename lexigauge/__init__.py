"""Spark-native analytics for evaluating the quality of written text."""
