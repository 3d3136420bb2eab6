"""Operators for training-data pipelines: search, deduplication, packing, encoding, language and personal-data models."""
