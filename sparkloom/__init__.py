"""A Spark-native engine for source-code and document corpora."""
