"""Operators for training data: filters, near duplicates, tokens, mixing, search.

Nothing else in the library imports this package. Each module holds one
operator with its own interface; ``queries`` applies them to the given tables.
"""
