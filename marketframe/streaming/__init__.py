"""Streaming of marketframe."""
