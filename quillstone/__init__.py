"""quillstone: a PySpark-native engine for code/text search, corpus statistics and relational analytics."""

__version__ = "0.1.0"
