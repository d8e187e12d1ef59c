"""Plans of the cube engine."""
