"""Sources of marketframe."""
