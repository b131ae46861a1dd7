"""Semiring relational engine on PySpark DataFrames."""
