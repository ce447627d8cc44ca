"""Frame analytics and media-operations tables on Apache Spark."""

__version__ = "0.1.0"
