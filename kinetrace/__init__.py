"""Spark-native analytics for multi-node motion-sensor time series."""
