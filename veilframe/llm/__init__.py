"""Operators of a training-data pipeline: deduplication, filters, mixing, token work, search, packing."""
