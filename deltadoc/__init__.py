"""Comparison of document versions as Spark DataFrames."""

__version__ = "0.1.0"
