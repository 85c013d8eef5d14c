"""Lightloom operators."""
