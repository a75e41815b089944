"""Composite plans made of several operators."""
