"""Sensitive-data detection, transformation and auditing on Spark DataFrames."""

__version__ = "0.1.0"
