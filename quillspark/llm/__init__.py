"""Training-data operators: search, packing, deduplication, extraction, mixing, language ID, sharding.

Nothing outside this package imports it; removing the folder leaves the rest of the library working.
"""
