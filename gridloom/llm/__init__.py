"""Operators for preparing training text: deduplication, filtering, packing and encoding.

Nothing else in the library imports this subpackage.
"""
