"""Operators of the visibility engine."""
