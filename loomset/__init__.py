"""Functional, database-in/database-out analytics on PySpark."""

__version__ = "0.1.0"
