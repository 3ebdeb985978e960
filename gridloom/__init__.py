"""Gridloom: a PySpark-native analytics engine."""

__version__ = "0.1.0"
