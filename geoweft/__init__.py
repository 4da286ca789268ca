"""Spark-native engine for tagged geographic feature graphs."""
