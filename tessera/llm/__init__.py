"""Corpus operators for training data: scoring, deduplication, search, mixing, packing, tool calls."""
