"""Operators of a training-data pipeline: filters, near-duplicates, scoring, archives and packing."""
