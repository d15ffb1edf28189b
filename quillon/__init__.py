"""Quillon: analytics over long structured documents, expressed as Spark DataFrames."""

__version__ = "0.1.0"
