"""Spark-native vector search: exact and approximate nearest neighbours on DataFrames."""
