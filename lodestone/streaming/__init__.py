"""Feeding an index from streams."""
