"""Paperloom: building and evaluating document-retrieval collections on PySpark."""

__version__ = "0.1.0"
