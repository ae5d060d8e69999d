"""Functions of the visibility engine."""
