"""Operators for preparing training text: mixing, filtering, near-duplicates, tokens and search."""
