"""Span-annotation analytics on Spark."""
