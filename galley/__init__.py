"""Spark-native engine for the editorial review of document corpora."""
