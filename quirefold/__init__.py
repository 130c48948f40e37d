"""Quirefold: a Spark-native index, query and preparation engine for document collections."""

__version__ = "0.1.0"
