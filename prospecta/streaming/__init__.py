"""Streaming of the visibility engine."""
