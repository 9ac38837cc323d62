"""Spark-native alignment of entities between knowledge graphs."""
