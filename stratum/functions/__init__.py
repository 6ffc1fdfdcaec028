"""Column expressions and hash functions."""
