"""lithic: a PySpark-native engine for evidence-backed knowledge data."""
