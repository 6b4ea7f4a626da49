"""Structured Streaming forms of the trajectory operators and of batched processing."""
