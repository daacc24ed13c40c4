"""sediment: a PySpark-native engine for building, searching and serving document corpora."""

__version__ = "0.1.0"
