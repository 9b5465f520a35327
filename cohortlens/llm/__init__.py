"""Operators and pipeline stages for training-data preparation.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin ``opN_``
queries over the given tables.
"""
