"""Corpus operators for training data: deduplication, quality, tokenizing,
packing, sharding, nearest neighbours and page extraction.

Nothing else in the library imports this subpackage.
"""
