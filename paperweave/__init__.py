"""A PySpark-native engine for paged documents: search, evidence retrieval, exact calculation, validation, lifecycle."""
