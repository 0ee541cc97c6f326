"""postwise: a posting-feed engine on PySpark (DataFrame, SQL and Structured Streaming)."""

__version__ = "0.1.0"
