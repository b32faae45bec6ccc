"""Layers and queries over the provided tables."""
