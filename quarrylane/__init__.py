"""Spark-native analytics over schemas, SQL corpora, dictionaries and documents."""

__version__ = "0.1.0"
