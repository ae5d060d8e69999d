"""Plans of the visibility engine."""
