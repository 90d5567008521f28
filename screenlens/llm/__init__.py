"""Operators that prepare training text: packing, formatting, filters, deduplication, search and scoring."""
