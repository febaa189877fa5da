"""gridsmith: a PySpark-native engine for Earth-observation metadata catalogues and corpus preparation."""

__version__ = "0.1.0"
