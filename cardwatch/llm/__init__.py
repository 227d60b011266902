"""Operators for preparing training text: scoring, encoding, deduplication, scanning, packing."""
