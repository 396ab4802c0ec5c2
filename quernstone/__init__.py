"""Quernstone: a Spark-native knowledge retrieval and evaluation engine."""
