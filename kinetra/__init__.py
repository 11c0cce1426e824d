"""Spark-native analytics for motion time series, road networks and training corpora."""
