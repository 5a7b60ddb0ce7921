"""Lodestone: a PySpark-native document retrieval and evaluation engine."""
