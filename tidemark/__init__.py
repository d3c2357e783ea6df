"""Tidemark: a point-in-time event analytics engine on PySpark."""

__version__ = "0.1.0"
