"""Spark-native analytics of memory-allocation event traces."""
