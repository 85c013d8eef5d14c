"""Lightloom: photometric time-series analytics as Spark DataFrame operators."""
