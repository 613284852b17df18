"""millrace: a Spark-first data preparation and business analytics engine."""

__version__ = "0.1.0"
