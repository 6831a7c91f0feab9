"""Spark-native analytics for personal-data requests: DataFrame-to-DataFrame transforms and named queries."""
