"""Spark-native engine for judging and preparing structured extractions at scale."""

__version__ = "0.1.0"
