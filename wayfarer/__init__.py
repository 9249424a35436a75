"""Spark-native analytics over indoor position signals."""
