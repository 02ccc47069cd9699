"""Operators for large training-data pipelines: fixity, extraction, search, encoding, dedup, scoring, sharding."""
