"""quern: Spark-native processing of large text corpora and training telemetry."""
