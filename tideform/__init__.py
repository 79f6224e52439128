"""Tideform: Spark-native analytics over bid/ask quote streams."""
