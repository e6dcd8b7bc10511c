"""Cadenza: a Spark-native engine for decomposable time-series analytics."""
