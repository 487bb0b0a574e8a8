"""Training-data operators: extraction, sharding, toxicity, decontamination, quality,
near and substring deduplication, archives, packing and chat formatting.

Nothing outside this subpackage imports it.
"""
