"""Derived tables, searches and map layers, composed of the operators."""
