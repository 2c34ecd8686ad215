"""Column and DataFrame operators of the change log."""
