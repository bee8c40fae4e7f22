"""A PySpark-native engine for tabular, sequence and genomic-interval data."""

__version__ = "0.1.0"
