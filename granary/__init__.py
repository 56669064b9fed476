"""Spark-native corpus building and measuring."""
