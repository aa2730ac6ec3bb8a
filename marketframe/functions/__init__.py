"""Functions of marketframe."""
