"""A PySpark-native engine for chunked clustering of large point sets."""
