"""PySpark-native document, chunk and embedding analytics."""
