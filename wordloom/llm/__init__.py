"""Operators for preparing training data: dedup, filters, extraction, encoding.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general DataFrame interface; ``queries`` registers one query for each.
"""
