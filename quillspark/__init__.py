"""A Spark-native engine for large multilingual text corpora."""
