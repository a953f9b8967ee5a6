"""Spark-native retrieval, knowledge-graph and library management engine."""
