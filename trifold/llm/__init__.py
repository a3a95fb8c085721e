"""Corpus operators for training data: deduplication, filters, packing."""
