"""Operators for preparing training text: filters, tokens, near-duplicates, packing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
