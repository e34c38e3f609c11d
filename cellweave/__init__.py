"""cellweave: Spark-native analytics over time-lapse object tables."""
