"""Spark-native engine for private release of tabular data."""
