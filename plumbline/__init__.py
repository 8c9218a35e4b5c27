"""plumbline: a Spark-native SQL assurance engine."""
