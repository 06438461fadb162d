"""Corpus operators for training data: filtering, deduplication, mixing, scoring and token output.

Nothing outside this subpackage imports it.
"""
