"""Spark-native analytics: facilities, catchments, river exposure, and corpus operators."""
