"""Spark-native content-evidence analytics."""
