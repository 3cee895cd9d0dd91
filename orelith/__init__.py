"""Orelith: a Spark-native engine that indexes, searches, compares and audits code and text collections."""

__version__ = "0.1.0"
