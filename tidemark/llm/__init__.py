"""Operators for preparing training text: filtering, deduplication, scoring, tokenising and packing."""
