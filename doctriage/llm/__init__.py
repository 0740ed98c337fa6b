"""Operators for preparing training data: dedup, filtering, mixing, packing, search, scoring."""
