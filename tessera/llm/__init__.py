"""Training-data operators: deduplication, filtering, mixing, search.

Nothing else in the library imports this subpackage.
"""
