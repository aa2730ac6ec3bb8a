"""Operators of marketframe."""
