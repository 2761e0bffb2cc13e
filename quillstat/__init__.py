"""Spark-native analytics for game statistics and player-tracking tables."""
