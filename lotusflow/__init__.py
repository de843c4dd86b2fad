"""PySpark-native retrieval and corpus analytics."""
