"""Spark-native engine for collecting, normalising and analysing job listings."""

__version__ = "0.1.0"
