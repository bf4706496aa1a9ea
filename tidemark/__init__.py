"""A Spark-native engine for key/value mutation histories."""
