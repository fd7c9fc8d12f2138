"""Readers of feeds, city models and census tables, and writers of derived tables."""
