"""Operators that prepare a training corpus: filters, deduplication, scoring, extraction and mixing.

Nothing else in the library imports this subpackage.
"""
