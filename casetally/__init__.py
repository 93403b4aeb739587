"""Spark-native evaluation of classifiers and repeated text responses over tables."""

__version__ = "0.1.0"
