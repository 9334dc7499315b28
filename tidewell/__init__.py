"""A Spark-native engine for listings of time-limited opportunities."""
