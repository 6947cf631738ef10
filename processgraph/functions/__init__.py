"""Scalar functions: Column expressions where Spark has them, plain Python parsers otherwise."""
