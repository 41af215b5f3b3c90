"""Spark-native analytics for page annotations, identity retrieval and ranking."""
