"""Ordered, multi-version key-value analytics expressed as PySpark DataFrames."""
