"""Tessella: a Spark-native engine for image cohorts, tiles and their quality data."""

__version__ = "0.1.0"
