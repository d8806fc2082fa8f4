"""Scalar functions: text, hashes, arrays, dates."""
