"""docspark: a PySpark-native document analytics and retrieval engine."""
