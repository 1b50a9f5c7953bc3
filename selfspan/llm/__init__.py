"""Operators for preparing text corpora: deduplication, scoring, filtering, mixing and sharding."""
