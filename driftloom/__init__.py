"""Driftloom: declarative schema evolution and verified data migration on PySpark."""

__version__ = "0.1.0"
