"""Spark-native analytics over a graph of facts extracted from text."""
