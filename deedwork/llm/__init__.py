"""Operators that prepare a training corpus: archives, deduplication, scoring, packing, sharding."""
