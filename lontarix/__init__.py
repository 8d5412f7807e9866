"""Spark-native engine for versioned, source-cited document corpora."""
