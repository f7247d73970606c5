"""Millrace: analytics over semi-structured text records, declared as Spark DataFrame plans."""

__version__ = "0.1.0"
