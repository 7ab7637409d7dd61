"""Structured Streaming twins of the additive batch operators."""
