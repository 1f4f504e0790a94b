"""PySpark-native analytics engine for symbolic melody corpora."""
