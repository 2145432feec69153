"""Spark-native document structuring and deck planning."""
