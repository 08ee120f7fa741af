"""Operators for preparing training text, built on DataFrames.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries`` holds the thin queries over the
tables of a data directory.
"""
