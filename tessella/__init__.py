"""Spark-native landscape-connectivity analytics on categorical rasters."""
