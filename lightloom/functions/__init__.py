"""Lightloom functions."""
