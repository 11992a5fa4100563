"""Spark-native entity linking, co-occurrence graph analytics and corpus preparation."""
