"""Structured Streaming wrappers of the stateless operators."""
