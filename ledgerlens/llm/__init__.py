"""Operators for preparing training data: deduplication, cleaning, classification, mixing and sharding."""
