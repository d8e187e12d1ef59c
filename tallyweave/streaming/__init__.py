"""Streaming of the cube engine."""
