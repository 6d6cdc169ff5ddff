"""tidemark: a Spark-native engine for versioned, provenance-tracked belief records."""

__version__ = "0.1.0"
