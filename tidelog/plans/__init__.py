"""Decisions that a driver takes from small aggregates."""
