"""Operators for preparing training data: packing, mixing, dedup, scoring and filtering of documents.

Nothing outside this subpackage imports it.
"""
