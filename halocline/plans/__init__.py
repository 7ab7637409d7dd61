"""Composed queries over the supplied tables."""
