"""Sources of the visibility engine."""
