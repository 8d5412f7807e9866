"""Operators of a training-data pipeline: packing, sharding, search, cleaning, archives, tokens, scoring and dedup."""
