"""Operators for large text corpora: detection, deduplication, packing and storage.

Nothing else in the library imports this subpackage.
"""
