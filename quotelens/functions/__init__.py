"""Scalar text functions as Column expressions, and the traced rewriting that recovers source coordinates."""
