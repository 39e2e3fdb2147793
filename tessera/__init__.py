"""Tessera: Spark-native analytics for source-code corpora, their change history, and training data."""
