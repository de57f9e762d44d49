"""Matched-model fare price index on Spark: clean, pair, index, explain, validate."""

__version__ = "0.1.0"
