"""Spark-first analytics over geolocated, categorised event records."""
