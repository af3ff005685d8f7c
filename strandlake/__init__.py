"""strandlake: a Spark-native engine for columnar series data."""

__version__ = "0.1.0"
