"""Describe, check and deliver tabular and streaming data with PySpark."""
