"""Lightloom sources."""
