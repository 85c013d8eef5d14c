"""Sinusoids, phases, errors and weights as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def finite(x: Column) -> Column:
    """NaN and infinities become NULL, so that aggregates skip them."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def sinusoid(t: Column, f: Column, s: Column, c: Column) -> Column:
    return s * F.sin(TAU * f * t) + c * F.cos(TAU * f * t)


def amplitude(s: Column, c: Column) -> Column:
    return F.sqrt(s * s + c * c)


def phase(s: Column, c: Column) -> Column:
    return F.atan2(c, s)


def _error(ga: Column, gb: Column, ss: Column, sc: Column, cc: Column) -> Column:
    variance = ga * ga * ss + 2 * ga * gb * sc + gb * gb * cc
    return F.when(variance >= 0, F.sqrt(variance))


def amplitude_error(s: Column, c: Column, ss: Column, sc: Column, cc: Column) -> Column:
    """By gradient; at zero amplitude along the diagonal; null for a negative variance."""
    a, diagonal = amplitude(s, c), F.lit(1 / math.sqrt(2))
    return _error(F.when(a > 0, s / a).otherwise(diagonal), F.when(a > 0, c / a).otherwise(diagonal), ss, sc, cc)


def phase_error(s: Column, c: Column, ss: Column, sc: Column, cc: Column) -> Column:
    a2 = s * s + c * c
    return F.when(a2 > 0, _error(-c / F.nullif(a2, F.lit(0.0)), s / F.nullif(a2, F.lit(0.0)), ss, sc, cc))


def period(f: Column) -> Column:
    return F.when(f > 0, F.lit(1.0) / F.nullif(f, F.lit(0.0)))


def fold(t: Column, f: Column, t0: Column | float = 0.0) -> Column:
    return F.pmod((t - (t0 if isinstance(t0, Column) else F.lit(t0))) * f, F.lit(1.0))


def wrapped(phi: Column) -> Column:
    return F.atan2(F.sin(phi), F.cos(phi))


def combined_power(p1: Column, p2: Column, w1: float | Column = 1.0, w2: float | Column = 1.0, eps: float = 1e-30) -> Column:
    """Weighted geometric mean; what is no positive number counts as ``eps``."""
    safe = lambda p: F.greatest(F.coalesce(finite(p), F.lit(eps)), F.lit(eps))
    return F.exp((w1 * F.ln(safe(p1)) + w2 * F.ln(safe(p2))) / (w1 + w2))


def dataset_weight(mode: str, chunk: Column, given: float = 1.0) -> Column:
    """Weight of a data set in a combined spectrum: ``equal`` (1), ``sqrt`` of the longest chunk (1 where that is not
    positive) or ``manual`` (``given``)."""
    if mode == "equal":
        return F.lit(1.0)
    if mode == "manual":
        return F.lit(float(given))
    if mode != "sqrt":
        raise ValueError("mode is equal, sqrt or manual")
    return F.when(chunk > 0, F.sqrt(chunk)).otherwise(1.0)


def signal_weight(err: Column) -> Column:
    e = finite(err)
    return F.when(e > 0, 1 / F.nullif(e * e, F.lit(0.0))).otherwise(F.lit(0.0))


def pixel_radius(row: Column, col: Column, seed_row: Column, seed_col: Column) -> Column:
    return F.sqrt((row - seed_row) * (row - seed_row) + (col - seed_col) * (col - seed_col))


def in_circle(row: Column, col: Column, seed_row: Column, seed_col: Column, radius: float) -> Column:
    return (row - seed_row) * (row - seed_row) + (col - seed_col) * (col - seed_col) <= radius * radius
