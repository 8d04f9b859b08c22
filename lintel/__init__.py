"""lintel: Spark-native analytics for funding flows and their project texts."""

__version__ = "0.1.0"
