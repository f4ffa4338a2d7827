"""foliospark: a PySpark-native engine for cached web pages, scans and converted documents."""

__version__ = "0.1.0"
