"""Sources of the cube engine."""
