"""Operators for training-data pipelines: filters, near-duplicates, extraction, mixing."""
