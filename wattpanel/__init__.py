"""Spark-native panel time-series features and scoring."""

__version__ = "0.1.0"
