"""Spark-native analytics for team-based ranked matches."""
