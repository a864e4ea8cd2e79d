"""Operators of a training-data pipeline: filtering, deduplication, search, packing, archives."""
