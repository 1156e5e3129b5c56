"""Operators of a training-data pipeline: packing, deduplication, archives, filters."""
