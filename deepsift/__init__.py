"""Spark-native analytics for low-frequency variants in deep sequencing data."""
