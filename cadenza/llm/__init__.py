"""Training-data operators: sharding, packing, deduplication, scanning, scoring.

Nothing outside this subpackage imports it.
"""
