"""A Spark-native engine for verifiable certificate maps."""
