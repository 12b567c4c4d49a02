"""Excerpt location on Spark."""
