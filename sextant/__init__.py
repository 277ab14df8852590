"""Spark-native index and search over source code, documentation and their vectors."""

__version__ = "0.1.0"
