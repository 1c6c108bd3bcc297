"""Spark-native analytics for construction specifications, submittals and training corpora."""

__version__ = "0.1.0"
