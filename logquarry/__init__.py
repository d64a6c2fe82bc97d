"""A Spark-native engine for searching, parsing and analysing logs and text."""
