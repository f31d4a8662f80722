"""Operators for preparing training data: packing, tokenising, deduplication, retrieval.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries.
"""
