"""Spark-native operators for chipped imagery, scene catalogs, wind series and detection metrics."""
