"""Operators for large training-text corpora.

Each module holds one operator with its own general interface (a DataFrame in,
a DataFrame out, column names as parameters); ``queries`` registers the thin
queries over the test tables.  Nothing else in the library imports this
subpackage.
"""
