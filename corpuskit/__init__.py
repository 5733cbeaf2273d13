"""A PySpark-native engine for building and querying AI corpora."""

__version__ = "0.1.0"
