"""Spark-native engine for time-coded records and corpus preparation."""
