"""Structured Streaming forms of the bucketing operators."""
