"""Spark-native analytics over a commercial knowledge graph."""
