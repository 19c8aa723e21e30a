"""Operators for preparing training data: mixing, sharding, near duplicates, quality, archives, tokens, packing."""
