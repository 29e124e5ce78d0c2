"""Operators for training-data corpora: deduplication, tokens, quality, search, packing, sharding."""
