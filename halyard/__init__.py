"""Halyard: exact and graph-based vector search as DataFrame plans on Spark."""

__version__ = "0.1.0"
