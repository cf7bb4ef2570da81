"""A Spark-native engine for multi-view capture evidence."""
