"""Operators for large training-data pipelines.

Nothing outside this folder imports it.  Each module holds one operator with a general interface;
``queries.py`` holds the thin queries that apply them to the standard tables.
"""
