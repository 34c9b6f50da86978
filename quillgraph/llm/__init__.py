"""Operators for preparing training text: dedup, extraction, encoding, filtering, packing."""
