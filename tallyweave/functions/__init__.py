"""Functions of the cube engine."""
