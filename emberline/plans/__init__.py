"""Whole jobs, and the catalogue of named queries with their SQL twins."""
