"""Spark-native evidence reconciliation and similarity search."""
