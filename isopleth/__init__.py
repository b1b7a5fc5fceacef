"""Spark-native analysis of gridded climate time series, and preparation of text corpora."""

__version__ = "0.1.0"
