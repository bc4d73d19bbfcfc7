"""Operators for building training data: scans, near-duplicates, packing, mixing, formatting."""
