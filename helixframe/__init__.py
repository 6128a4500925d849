"""Sequence-homology analytics on PySpark."""
