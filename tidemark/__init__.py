"""tidemark: a PySpark-native analytics engine for personal event streams."""
