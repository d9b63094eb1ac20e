"""Spark-native scoring, ranking and validation of growth of point-located entities."""
