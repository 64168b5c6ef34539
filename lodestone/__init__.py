"""Spark-native assay analytics engine."""
