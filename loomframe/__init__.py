"""Spark-native analytics for screen-interaction datasets."""
