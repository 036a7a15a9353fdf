"""Training-data operators: deduplication, quality, language, packing, mixing and sharding.

Nothing outside this subpackage imports it.
"""
