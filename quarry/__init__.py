"""Spark-native document search and ranking engine."""
