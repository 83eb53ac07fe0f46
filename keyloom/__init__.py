"""Keyloom: bit-descriptor ordering and analytics on PySpark DataFrames."""
