"""Operators of the cube engine."""
