"""tidemark: a PySpark-native time-series engine."""
