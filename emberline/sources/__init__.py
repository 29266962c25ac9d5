"""Readers, keyed writers and the adapters over the given tables."""
