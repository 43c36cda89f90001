"""Operators for preparing large text corpora: filtering, deduplication, mixing, tokenization, search.

Nothing else in the package imports this subpackage.
"""
