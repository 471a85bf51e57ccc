"""Spark-native analytics over company fundamentals, prices and financial text."""
