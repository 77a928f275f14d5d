"""PySpark-native analytics over source-code repositories."""
