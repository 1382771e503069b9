"""Training-data operators: mixing, deduplication, scoring, search, encoding and media columns.

Nothing else in the library imports this subpackage; it may be deleted as a whole.
"""
