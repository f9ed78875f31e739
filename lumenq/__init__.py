"""Spark-native engine for evaluating uncertainty signals on generated text."""

__version__ = "0.1.0"
