"""Spark-native analytics and retrieval engine for multi-turn dialogue corpora."""
