"""Operators for preparing training data: deduplication, filtering, tokenising, packing and search."""
