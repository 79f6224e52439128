"""Training-data operators: licence lookup, tokenising, deduplication, scoring, extraction and mixing.

Nothing outside this subpackage imports it.
"""
