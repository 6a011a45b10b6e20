"""Part of the Spark-native record-linkage engine."""
