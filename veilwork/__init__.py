"""Declarative data masking, privacy audit and corpus preparation on Spark."""

__version__ = "0.1.0"
