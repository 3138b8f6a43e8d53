"""A Spark-native analytics engine for media catalogs."""
