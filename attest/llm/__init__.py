"""Operators for preparing training text: packing, deduplication, filters, tokenisation, search and sharding."""
