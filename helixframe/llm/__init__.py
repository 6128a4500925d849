"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the registered queries and their SQL.
"""
