"""Operators for large text corpora, built on Spark DataFrames.

Nothing else in the library imports this subpackage.  Each operator module
has a general function on DataFrames; ``queries`` holds the thin ``opN_*``
queries over the ``documents`` tables.
"""
