"""Relational building blocks that Spark has no single call for."""
