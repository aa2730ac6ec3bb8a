"""Plans of marketframe."""
