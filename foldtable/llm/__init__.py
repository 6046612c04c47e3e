"""Training-data operators: sharding, tokenizing, deduplication, filtering and archives.

Nothing outside this subpackage imports it.
"""
