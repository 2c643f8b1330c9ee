"""Training-data operators: near-dedup, packing, tokenising, scans, quality, search.

Nothing else in the library imports this subpackage.
"""
