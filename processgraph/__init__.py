"""Typed, weighted, contextual process graphs held as Spark tables."""
