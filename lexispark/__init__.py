"""lexispark: a Spark-native engine for text-corpus analytics."""
