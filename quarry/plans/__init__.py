"""Reusable plan shapes: skew-safe keyed sequences, exact quantiles, stand-in inputs."""
