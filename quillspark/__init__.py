"""Spark-native string, nested-path, deep-copy and file-storage operators."""
