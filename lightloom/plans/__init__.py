"""Registered queries: operators composed over the given tables, each with its DuckDB SQL where SQL can express it."""

from . import basics, compositions, images, names, spectra
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "basics", "compositions", "images", "names", "spectra"]
