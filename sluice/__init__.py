"""sluice: metadata-driven ingestion as set-based Spark DataFrame operators."""

__version__ = "0.1.0"
