"""Spark-native analytics for road networks, traffic measurements and trips."""
