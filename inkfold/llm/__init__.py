"""Training-data operators: deduplication, mixing, tokens, sharding, packing, filters.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
