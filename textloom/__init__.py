"""Spark-native text retrieval: positional index, boolean, ranked, wildcard and spelling queries over DataFrames."""
