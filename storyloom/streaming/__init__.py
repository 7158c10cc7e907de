"""Structured Streaming wrappers: the same transformations as in batch, run once over what is new."""
