"""Readers and generators of changes."""
