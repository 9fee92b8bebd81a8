"""Training-data operators: archives, deduplication, mixing, tokenising, quality and extraction.

Nothing outside this subpackage imports it.
"""
