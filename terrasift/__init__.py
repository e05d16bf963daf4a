"""Spatial and survey analytics on PySpark."""
