"""Operators for large training-text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` holds the thin contract queries.
"""
