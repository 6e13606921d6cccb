"""Operators for training text: quality, deduplication, language, packing, extraction and the like."""
