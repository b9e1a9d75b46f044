"""Spark-native analytics over time-ordered events, segments and their labels."""
