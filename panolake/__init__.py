"""Spark-native analytics for geo-referenced object detections in panoramic imagery."""
