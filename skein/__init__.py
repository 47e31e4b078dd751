"""Spark-native retrieval analytics: every operator is a DataFrame -> DataFrame function."""
