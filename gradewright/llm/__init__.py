"""Operators for preparing training text: deduplication, filtering, mixing, formatting and sharding."""
