"""Operators that prepare training text: search, deduplication, tokens, scores and packing."""
