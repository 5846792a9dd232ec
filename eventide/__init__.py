"""Eventide: a Spark-native engine for stores of signed, tagged events."""
