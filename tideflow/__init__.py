"""Ordered-flow analytics on PySpark: DataFrames with an explicit order key, and the operators over them."""
