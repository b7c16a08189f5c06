"""Training-data operators: search, archives, deduplication, packing, filtering and mixing.

Nothing outside this folder imports it.
"""
