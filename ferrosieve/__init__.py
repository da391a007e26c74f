"""Ferrosieve: a Spark-native engine for technical-literature pipelines."""

__version__ = "0.1.0"
