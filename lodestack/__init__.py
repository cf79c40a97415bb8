"""Spark-native code-context retrieval: parse, score, rank, expand, pack and render, all as DataFrame plans."""
