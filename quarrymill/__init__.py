"""PySpark-native source-code quality analytics."""
