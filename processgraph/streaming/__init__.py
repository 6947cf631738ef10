"""Structured Streaming variants of the stateful context operators."""
