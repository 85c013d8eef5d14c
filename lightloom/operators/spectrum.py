"""Periodograms and what is read from them, for all series and frequencies in one plan.

A spectrum is rows (series_id, j, f, power). Grids are even (``frequency_grid``, ``local_grid``), so a sample carries only its
series' first frequency, step and size. A task turns its samples into sums of waves with a few matrix products a series, or FFTs
where it has many (``wave_sums``); no row is made for a sample and a frequency. One per task, frequency and series of more than
``WHOLE`` points is shuffled; smaller series are summed whole, their samples are shuffled instead.
"""

from __future__ import annotations

import functools
import itertools
import math
from bisect import bisect, bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.waves import amplitude, amplitude_error, phase, phase_error, signal_weight
from ..tables import discard, stored
from .regress import least_norm
from .series import by, trimmed_median

TAU = 2 * math.pi
#: Fit windows and noise guards reach this many times 2 / T.
KFIT = 3.0
#: Sides of a noise window, in 1 / T and in bins at least; the highest share of a window that is left out.
SIDES, SIDE_BINS, TRIM = 15.0, 30, 0.1


class Fit(NamedTuple):
    """What a task makes of one series' sums: ``of`` takes the sums without waves of each of its keys (keys by n0, sy, syy, uu, uy,
    points) and those of waves (keys by waves by frequencies) and gives ``columns``, each an array with nulls or NaN. With ``least``
    only the frequency of the smallest value of that column stays."""

    columns: tuple[str, ...]
    of: Callable[[np.ndarray, np.ndarray], list[pa.Array]]
    least: str | None = None


class Baseline(NamedTuple):
    """What stands beside a sinusoid in a fit: one offset, or an offset and a slope (or either) for each ``night``; ``weight``
    names the column of the points' weights."""

    night: str | None = None
    offsets: bool = True
    slopes: bool = False
    weight: str | None = None

    @classmethod
    def of(cls, given: Baseline | str | None, slopes: bool = False) -> Baseline:
        """A baseline, also from a night column alone. Nights of neither offset nor slope have one offset in all."""
        out = given if isinstance(given, Baseline) else cls(given, slopes=slopes)
        return out if out.night and (out.offsets or out.slopes) else cls(weight=out.weight)

    @property
    def columns(self) -> list[str]:
        return [c for c in (self.night, self.weight) if c]

    @property
    def w(self) -> Column:
        return F.col(self.weight).cast("double") if self.weight else F.lit(1.0)


class Samples(NamedTuple):
    """Points that many passes read (``packed_samples``): ``rows`` are those of series of ``WHOLE`` points at most, ``packed`` arrays of points
    of longer ones, by series and night; None where there are none."""

    rows: DataFrame | None
    packed: DataFrame | None

    def less(self, fits: DataFrame, only: bool = False) -> Samples:
        """Without the fitted sinusoids (series_id, f, s_coeff, c_coeff); series without a fit stay as they are, or go (``only``).
        The baseline stays: every fit beside it projects it off."""
        own = fits.select("series_id", F.struct("f", "s_coeff", "c_coeff").alias("wave_"))
        return self._less(own, lambda t, w: w["s_coeff"] * np.sin(TAU * w["f"] * t) + w["c_coeff"] * np.cos(TAU * w["f"] * t), only)

    def less_harmonics(self, fits: DataFrame) -> Samples:
        """Without the fits of an offset and harmonics (series_id, f, beta: offset, then a sine and a cosine each)."""
        return self._less(fits.select("series_id", F.struct("f", "beta").alias("wave_")), lambda t, w: harmonic_wave(t, w["f"], w["beta"]), False)

    def _less(self, fits: DataFrame, wave: Callable[[np.ndarray, dict], np.ndarray], only: bool) -> Samples:
        how = "inner" if only else "left"

        def rest(t: np.ndarray, y: np.ndarray, waves: pa.Array) -> np.ndarray:
            own = pc.dictionary_encode(waves.field("name_"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            y, order = y.copy(), np.argsort(own, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                w = waves[int(at[0])].as_py()
                if None not in w.values():
                    y[at] -= wave(t[at], w)
            return y

        def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    t, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "y"))
                    yield _replaced(batch, pa.array(rest(t, y, batch.column("wave_"))))

        def of_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one, w = batch.slice(i, 1), batch.column("wave_")[i].as_py()
                    if None not in w.values():
                        t, y = (np.frombuffer(one.column(c)[0].as_buffer()) for c in ("t", "y"))
                        one = _replaced(one, pa.array([(y - wave(t, w)).tobytes()], pa.binary()))
                    else:
                        one = _replaced(one, one.column("y"))
                    yield one

        def joined(points: DataFrame) -> DataFrame:
            both = points.join(fits if points is self.rows else F.broadcast(fits), "series_id", how)
            return both.withColumn("wave_", F.struct(F.col("series_id").alias("name_"), "wave_.*"))

        done = [None if points is None else stored(joined(points).mapInArrow(f, points.schema), "samples") for points, f in ((self.rows, of_rows), (self.packed, of_packed))]
        return Samples(*done)

    def renamed(self, names: DataFrame) -> Samples:
        """Every series once for each of its new names (series_id, key_)."""
        own = lambda points, names: points.join(names, "series_id").drop("series_id").withColumnRenamed("key_", "series_id")
        return Samples(None if self.rows is None else own(self.rows, names), None if self.packed is None else own(self.packed, F.broadcast(names)))

    def discard(self) -> None:
        for points in self:
            if points is not None:
                discard(points)


def harmonic_wave(t: np.ndarray, f: float, beta: list[float]) -> np.ndarray:
    """The offset and sinusoids of ``harmonic_fit``."""
    out = np.full(len(t), beta[0])
    for h, (s, c) in enumerate(zip(beta[1::2], beta[2::2], strict=True), 1):
        angle = TAU * h * f * t
        out += s * np.sin(angle) + c * np.cos(angle)
    return out


def _replaced(batch: pa.RecordBatch, y: pa.Array) -> pa.RecordBatch:
    """The batch with another y and without its wave."""
    names = [n for n in batch.schema.names if n != "wave_"]
    return pa.RecordBatch.from_arrays([y if n == "y" else batch.column(n) for n in names], names)


def _groups(batch: pa.RecordBatch, names: tuple) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, its rows) of a batch, by first appearance."""
    code = np.zeros(batch.num_rows, np.int64)
    for n in names:
        own = pc.dictionary_encode(batch.column(n), null_encoding="encode")
        code = code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []
    for at in sorted(groups, key=lambda at: at[0]):
        yield tuple(batch.column(c)[int(at[0])].as_py() for c in names), at


def packed_samples(series: DataFrame, baseline: Baseline | str | None = None) -> Samples:
    """``series`` for many passes: which series are long is counted once, and their points are packed in the tasks that have them (beside
    nights: dealt by night and time), so that a pass moves no rows. Points without t, y or a positive weight are left out."""
    b = Baseline.of(baseline)
    names = ("series_id", *([b.night] if b.night else []))
    rows = series.withColumn("u_", _night_slopes(series, b) if b.slopes else F.lit(0.0))
    rows = rows.select(*names, F.col("t").cast("double"), F.col("y").cast("double"), b.w.alias("w_"), "u_").filter("t is not null and y is not null and w_ > 0 and series_id is not null")
    sizes = stored(rows.groupBy("series_id").agg(F.count("*").alias("size_")), "sizes")
    ends = sizes.agg(F.min("size_").alias("a"), F.max("size_").alias("z")).first()
    short, long = (sizes.filter(c) for c in (F.col("size_") <= WHOLE, F.col("size_") > WHOLE))
    small = large = None
    if ends.a is None or ends.a <= WHOLE:
        small = stored(rows.join(short.select("series_id"), "series_id", "left_semi"), "samples")
    if ends.z is not None and ends.z > WHOLE:
        kept = ("t", "y", *(["w_"] if b.weight else []), *(["u_"] if b.slopes else []))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {}

            def told(key: tuple) -> pa.RecordBatch:
                points = np.concatenate(held.pop(key), 1)
                columns = [pa.array([v], kind) for v, kind in zip(key, kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*columns, *[pa.array([x.tobytes()], pa.binary()) for x in points]], [*names, *kept])

            for batch in batches:
                points = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in kept])
                for key, at in _groups(batch, names):
                    held.setdefault(key, []).append(points[:, at])
                    if sum(x.shape[1] for x in held[key]) >= _CHUNK:
                        yield told(key)
            for key in list(held):
                yield told(key)

        kinds = [to_arrow_type(rows.schema[n].dataType) for n in names]
        schema = T.StructType([rows.schema[n] for n in names])
        for c in kept:
            schema = schema.add(c, T.BinaryType())
        points = rows.join(F.broadcast(long), "series_id")
        if b.night:
            points = _dealt(points, names)
        # few large rows are dealt anew, whatever the tasks had: a pass is as long as its longest task
        large = stored(points.mapInArrow(pack, schema).repartition(series.sparkSession.sparkContext.defaultParallelism), "samples")
    return Samples(small, large)


def _dealt(long: DataFrame, names: tuple) -> DataFrame:
    """Nights have sums of their own: a task gets few of them."""
    tasks = 2 * long.sparkSession.sparkContext.defaultParallelism
    return long.repartition(tasks, *names, F.pmod(F.xxhash64("t"), F.ceil(F.col("size_") / (1 << 20))))


def with_weights(series: DataFrame, err: str = "yerr", weight: str = "weight") -> DataFrame:
    """Adds 1 / err^2, 0 where err is no positive number; a series without any error has equal weights."""
    some = F.count(F.when(~F.isnan(err), F.col(err))).over(by()) > 0
    return series.withColumn(weight, F.when(some, signal_weight(F.col(err))).otherwise(F.lit(1.0)))


def grid_size(fmin: float | Column, fmax: float | Column, df: Column, most: int) -> Column:
    return F.least(F.floor((fmax - fmin) / df) + 1, F.lit(most)).cast("long")


def frequency_grid(spans: DataFrame, fmin: float, fmax: float, span: str = "t_full", oversample: float = 1.0, most: int = 60_000) -> DataFrame:
    """(series_id, j, f): steps of 1 / (span * oversample) from fmin; too many points become ``most`` even ones."""
    df = 1.0 / F.greatest(F.col(span), F.lit(1e-8)) / oversample
    full = F.floor((fmax - fmin) / df) + 1
    step = F.when(full > most, F.lit((fmax - fmin) / max(most - 1, 1))).otherwise(df)
    grid = spans.select("series_id", step.alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.least(full, F.lit(most)), F.lit(1)).cast("long") - 1)).alias("j"))
    return grid.select("series_id", "j", (F.lit(fmin) + F.col("j") * F.col("step")).alias("f"))


def local_grid(centres: DataFrame, half: Column, df: Column, fmin: float, fmax: float, most: int = 1201) -> DataFrame:
    """Even points over centre +- half within the limits: floor(span / df) + 1 of them, between 11 and ``most``."""
    low, high = F.greatest(F.lit(fmin), F.col("f0") - half), F.least(F.lit(fmax), F.col("f0") + half)
    n = F.least(F.greatest(F.floor((high - low) / df) + 1, F.lit(11)), F.lit(most))
    rows = centres.withColumn("low_", low).withColumn("high_", high).withColumn("n_", n.cast("long"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1)))
    return rows.withColumn("f", F.col("low_") + F.col("j") * ((F.col("high_") - F.col("low_")) / (F.col("n_") - 1))).drop("low_", "high_", "n_")


def centred(sums: DataFrame, mean: bool = True) -> DataFrame:
    """Sums about the means: a, b, d, p, q, r = SS, CC, SC, YS, YC, YY."""
    n = F.col("n0")
    off = lambda xy, x, y: F.col(xy) - (F.col(x) * F.col(y) / n if mean else F.lit(0.0))
    return sums.withColumns({
        "a": off("sss", "ss", "ss"), "b": off("scc", "sc", "sc"), "d": off("ssc", "ss", "sc"),
        "p": off("sys", "sy", "ss"), "q": off("syc", "sy", "sc"), "r": off("syy", "sy", "sy"),
    })


def solved(sums: DataFrame) -> DataFrame:
    """Adds s_coeff, c_coeff, gain (drop of the residual sum of squares) and rss from centred sums."""
    det = F.col("a") * F.col("b") - F.col("d") * F.col("d")
    ok = det > 1e-12 * F.greatest(F.col("a") * F.col("b"), F.lit(1e-300))
    det = F.when(ok, det)
    s, c = (F.col("b") * F.col("p") - F.col("d") * F.col("q")) / det, (F.col("a") * F.col("q") - F.col("d") * F.col("p")) / det
    # one of the two columns is all there is when they are proportional
    single = F.greatest(F.coalesce(F.col("p") * F.col("p") / F.nullif(F.col("a"), F.lit(0.0)), F.lit(0.0)), F.coalesce(F.col("q") * F.col("q") / F.nullif(F.col("b"), F.lit(0.0)), F.lit(0.0)))
    out = sums.withColumn("s_coeff", s).withColumn("c_coeff", c)
    return out.withColumn("gain", F.coalesce(s * F.col("p") + c * F.col("q"), single)).withColumn("rss", F.col("r") - F.col("gain"))


_BLOCK = 256
_HELD = 1 << 22
#: Samples that a task gathers before they become sums; those of a key, from which on they are transformed.
_GATHERED, _MANY = 1 << 20, 4096
#: Points of an array of ``Samples``.
_CHUNK = 1 << 16
#: Places a frequency and terms of ``_wave_transform`` that leave 2e-15: many places and few terms for many samples.
_PLACES = ((2, 17), (4, 13), (8, 11), (16, 9), (64, 7))
#: A series of so many points at most is summed whole by one task.
WHOLE = 50_000


def _wave_products(t: np.ndarray, weights: np.ndarray, low: float, step: float, n: int, wanted: list[tuple[int, int]]) -> np.ndarray:
    """Sums of weight * exp(i m w t) at n even frequencies for each wanted (row of ``weights``, m).

    exp(i w t) is a product of a block's first wave and of one inside a block, so sums are matrix products."""
    inside = np.exp(1j * TAU * step * np.outer(t, np.arange(min(_BLOCK, n))))
    starts = np.exp(1j * TAU * np.outer(t, low + step * np.arange(0, n, _BLOCK)))
    powers = {1: (starts, inside)}
    for m in range(2, max(m for _, m in wanted) + 1):
        powers[m] = (powers[m - 1][0] * starts, powers[m - 1][1] * inside)
    return np.stack([((weights[k][:, None] * powers[m][0]).T @ powers[m][1]).ravel()[:n] for k, m in wanted])


def _wave_transform(t: np.ndarray, weights: np.ndarray, low: float, step: float, n: int, wanted: list[tuple[int, int]]) -> np.ndarray:
    """As ``_wave_products``, in a time that hardly depends on n for a sample.

    About the middle frequency a wave is exp(i TAU q u / size), q from -n / 2 to n / 2, u the sample's place among ``size`` even ones.
    u is a whole number and a rest of 1 / 2 at most, so the angle of the rest is pi / (2 places) at most, and some terms
    of its power series leave 2e-15. Sums of a term by whole places are one FFT."""
    places, terms = min(_PLACES, key=lambda x: x[1] * (10 * len(t) + x[0] * n * math.log2(2 * x[0] * n)))
    size, middle = 1 << math.ceil(math.log2(places * n)), n // 2
    q = np.arange(n) - middle
    angle, out = 1j * TAU * q / size, np.zeros((len(wanted), n), complex)
    for m in sorted({m for _, m in wanted}):
        u = t * (m * step * size)
        whole = np.rint(u)
        rest, at = u - whole, np.mod(whole, size).astype(np.int64)
        wave = np.exp(1j * TAU * (m * (low + middle * step)) * t)
        for row, (k, own) in enumerate(wanted):
            if own != m:
                continue
            z, factor = weights[k] * wave, np.ones(n, complex)
            for term in range(terms):
                sums = np.bincount(at, z.real, size) + 1j * np.bincount(at, z.imag, size)
                out[row] += factor * (np.fft.ifft(sums, norm="forward")[q])
                z, factor = z * rest, factor * angle / (term + 1)
    return out


def by_series(rows: DataFrame) -> DataFrame:
    """A series' rows in one of a given number of tasks. Without a number, few rows would be taken for little work; without the
    constant, a join's partitions by series, which are coalesced by their bytes, would do."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "series_id", F.lit(0))


def wave_sums(series: DataFrame, grid: DataFrame, *keys: str, weight: Column | None = None, slope: Column | None = None) -> DataFrame:
    """Weighted sums of products of 1, y, sin, cos (n0, sy, syy, ss, sc, sss, scc, ssc, sys, syc) by series_id, keys, j and f
    on an even grid, and the number of points; with ``slope``, u, also uu, uy, us, uc. Points without t, y or a positive
    weight are left out."""
    waves = {"w": (0, 1), "y": (1, 1), "d": (0, 2)} | ({"u": (2, 1)} if slope is not None else {})
    sums = _summed(series, grid, keys, weight, slope, waves)
    half = lambda sign: (F.col("n0") + sign * F.col("dc")) / 2
    sums = sums.withColumns({"sss": half(-1), "scc": half(1), "ssc": F.col("ds") / 2}).drop("dc", "ds")
    return sums.withColumnsRenamed({"ws": "ss", "wc": "sc", "ys": "sys", "yc": "syc"})


def harmonic_sums(series: DataFrame, grid: DataFrame, harmonics: int) -> DataFrame:
    """(series_id, j, f, xx, xy, yy, n): normal equations of an offset and ``harmonics`` sinusoids at every frequency. Products of
    waves are waves of the sums and differences of their multiples."""
    count = range(1, harmonics + 1)
    waves = {f"w{m}": (0, m) for m in range(1, 2 * harmonics + 1)} | {f"y{h}": (1, h) for h in count}
    sums = _summed(series, grid, (), None, None, waves)
    c = lambda m: F.col(f"w{abs(m)}c") if m else F.col("n0")
    s = lambda m: F.lit(0.0) if m == 0 else F.col(f"w{abs(m)}s") * (1 if m > 0 else -1)
    of = [("c", 0)] + [(kind, h) for h in count for kind in "sc"]

    def product(a: tuple[str, int], b: tuple[str, int]) -> Column:
        (x, h), (y, k) = a, b
        if x == y:
            return (c(h - k) + (1 if x == "c" else -1) * c(h + k)) / 2
        h, k = (h, k) if x == "s" else (k, h)
        return (s(h + k) + s(h - k)) / 2

    xx = F.array(*[product(a, b) for a in of for b in of])
    xy = F.array(F.col("sy"), *[F.col(f"y{h}{kind}") for h in count for kind in "sc"])
    return sums.select("series_id", "j", "f", xx.alias("xx"), xy.alias("xy"), F.col("syy").alias("yy"), F.col("n0").cast("long").alias("n"))


def harmonic_power(series: DataFrame | Samples, grid: DataFrame, harmonics: int, best: bool = False) -> DataFrame:
    """(series_id, j, f, power): share of the variance that an offset and ``harmonics`` sinusoids remove, solved where the sums are; with
    ``best`` only the frequency of the largest."""
    return _harmonic(series, grid, harmonics, best).select("series_id", "j", "f", "power")


def harmonic_fit(series: DataFrame | Samples, grid: DataFrame, harmonics: int) -> DataFrame:
    """(series_id, f, beta) of the frequency of the largest ``harmonic_power``: the offset, then a sine and a cosine for each harmonic."""
    beta = F.array(*[F.col(f"b{k}_") for k in range(2 * harmonics + 1)])
    return _harmonic(series, grid, harmonics, True).select("series_id", "f", beta.alias("beta"))


def _harmonic(series: DataFrame | Samples, grid: DataFrame, harmonics: int, best: bool) -> DataFrame:
    count = range(1, harmonics + 1)
    waves = {f"w{m}": (0, m) for m in range(1, 2 * harmonics + 1)} | {f"y{h}": (1, h) for h in count}
    of = [("c", 0)] + [(kind, h) for h in count for kind in "sc"]

    def powers(plain: np.ndarray, sums: np.ndarray) -> list[pa.Array]:
        (n0, sy, syy, *_), own = plain[0], sums[0]
        size = own.shape[1]
        cos = lambda m: own[abs(m) - 1].real if m else np.full(size, n0)
        sin = lambda m: own[abs(m) - 1].imag * (1 if m > 0 else -1) if m else np.zeros(size)
        xx = np.empty((size, len(of), len(of)))
        for i, (x, h) in enumerate(of):
            for k, (y, g) in enumerate(of):
                if x == y:
                    xx[:, i, k] = (cos(h - g) + (1 if x == "c" else -1) * cos(h + g)) / 2
                else:
                    a, b = (h, g) if x == "s" else (g, h)
                    xx[:, i, k] = (sin(a + b) + sin(a - b)) / 2
        xy = np.stack([np.full(size, sy), *[z for h in own[2 * harmonics :] for z in (h.imag, h.real)]], 1)
        (_, beta, rss), total = least_norm(xx, xy, np.full(size, syy)), syy - sy * sy / n0
        power = np.maximum(1 - rss / total, 0.0) if total != 0 else np.zeros(size)
        return [pa.array(power), *([pa.array(-power), *map(pa.array, beta.T.copy())] if best else [])]

    fit = Fit(("power", "less_", *[f"b{k}_" for k in range(len(of))]), powers, "less_") if best else Fit(("power",), powers)
    return _summed(series, grid, (), None, None, waves, fit)


def _summed(series: DataFrame | Samples, grid: DataFrame, keys: tuple, weight: Column | None, slope: Column | None, waves: dict[str, tuple[int, int]], fit: Fit | None = None) -> DataFrame:
    """By series_id, keys, j and f the sums n0, sy, syy, uu, uy, and of each named wave (weight w, w y or w u as 0, 1 or 2; multiple
    of the frequency) its cosine and sine parts, name + c and name + s. With ``fit`` a task makes its columns of a series' sums,
    by series_id, j and f. ``grid`` may also be packed: series_id, j0_, low_, high_, n_."""
    packed = grid if "low_" in grid.columns else grid.groupBy("series_id").agg(F.min("j").alias("j0_"), F.min("f").alias("low_"), F.max("f").alias("high_"), F.count("*").alias("n_"))
    step = F.coalesce((F.col("high_") - F.col("low_")) / F.nullif(F.col("n_") - 1, F.lit(0)), F.lit(0.0))
    packed = packed.select("series_id", "j0_", "low_", step.alias("step_"), "n_")
    names = ("series_id", *keys)
    if isinstance(series, Samples):
        first = series.rows if series.packed is None else series.packed
        name_types = first.schema
        small = None if series.rows is None else series.rows.join(packed, "series_id")
        long = None if series.packed is None else series.packed.join(F.broadcast(packed), "series_id")
    else:
        w, u = F.lit(1.0) if weight is None else weight, F.lit(0.0) if slope is None else slope
        rows = series.filter("t is not null and y is not null").select(*names, F.col("t").cast("double"), F.col("y").cast("double"), w.cast("double").alias("w_"), u.cast("double").alias("u_"))
        rows = rows.filter("w_ > 0")
        name_types = rows.schema
        packed = packed.join(rows.groupBy("series_id").agg(F.count("*").alias("size_")), "series_id")
        # one series of WHOLE points at least is long, so the table of these is small: their rows stay where they are
        long_ = F.broadcast(packed.filter(F.col("size_") > WHOLE))
        small = rows.join(long_.select("series_id"), "series_id", "left_anti").join(packed.filter(F.col("size_") <= WHOLE), "series_id")
        long = rows.join(long_, "series_id")
        if keys:
            long = _dealt(long, names)
    wanted = list(waves.values())

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for key, (place, scalars, sums) in held.items():
            for a in range(0, sums.shape[1], 4096):
                part = sums[:, a : a + 4096]
                lists = [x for row in part for x in (row.real, row.imag)]
                columns = [pa.array([v], t) for v, t in zip(key, kinds, strict=True)]
                columns += [pa.array([place[0] + a], pa.int64()), pa.array([a], pa.int64()), *[pa.array([x]) for x in (*place[1:], *scalars)]]
                columns += [pa.array([x], pa.list_(pa.float64())) for x in lists]
                yield pa.RecordBatch.from_arrays(columns, fields)

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, np.ndarray]]:
        """(key, one of its rows, samples) of rows or of packed arrays."""
        if not pa.types.is_binary(batch.schema.field("t").type):
            samples = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "y", "w_", "u_")])
            yield from ((key, int(at[0]), samples[:, at]) for key, at in _groups(batch, names))
            return
        for i in range(batch.num_rows):
            own = {c: np.frombuffer(batch.column(c)[i].as_buffer()) for c in batch.schema.names if c in ("t", "y", "w_", "u_")}
            size = len(own["t"])
            points = [own["t"], own["y"], own.get("w_", np.ones(size)), own.get("u_", np.zeros(size))]
            yield tuple(batch.column(c)[i].as_py() for c in names), i, np.stack(points)

    def gathered(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[tuple, tuple, np.ndarray]]:
        """(key, place, samples) of many samples each; once only of a key if series are ``whole`` and sorted."""
        waiting, count = {}, 0
        for batch in batches:
            for key, i, points in pieces(batch):
                if key not in waiting:
                    j0, low, step, n = (batch.column(c)[i].as_py() for c in ("j0_", "low_", "step_", "n_"))
                    waiting[key] = ((j0, low, step, n), [])
                waiting[key][1].append(points)
                count += points.shape[1]
            if count > _GATHERED:
                for key in list(waiting)[: -1 if whole else None]:
                    place, held = waiting.pop(key)
                    yield key, place, np.concatenate(held, 1)
                count = sum(x.shape[1] for _, held in waiting.values() for x in held)
        for key, (place, held) in waiting.items():
            yield key, place, np.concatenate(held, 1)

    def summed(t: np.ndarray, y: np.ndarray, w: np.ndarray, u: np.ndarray, low: float, step: float, n: int) -> tuple[np.ndarray, np.ndarray]:
        weights = np.stack([w, w * y, w * u])
        scalars = np.array([*[x.sum() for x in (w, w * y, w * y * y, w * u * u, w * u * y)], float(len(t))])
        return scalars, (_wave_transform if len(t) >= _MANY else _wave_products)(t, weights, low, step, n, wanted)

    def add(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for key, (j0, low, step, n), samples in gathered(batches, whole):
            scalars, total = summed(*samples, low, step, n)
            if key in held:
                place, old, sums = held[key]
                held[key] = (place, old + scalars, sums + total)
            else:
                held[key] = ((j0, low, step), scalars, total)
                size += total.size
            if size > _HELD:
                yield from emit(held)
                held, size = {}, 0
        yield from emit(held)

    def made(name: object, place: tuple, off: int, scalars: list, sums: list) -> list[pa.Array]:
        """A fit's rows of one series: series_id, j, f and its columns."""
        (j0, low, step), columns = place, fit.of(np.stack(scalars), np.stack(sums))
        at = off + np.arange(sums[0].shape[1])
        out = [pa.array([name] * len(at), kinds[0]), pa.array(j0 + at), pa.array(low + step * at), *columns]
        if fit.least:
            value = columns[fit.columns.index(fit.least)].to_numpy(zero_copy_only=False)
            best = int(np.argmin(np.where(np.isnan(value), np.inf, value)))
            out = [x.slice(best, 1) for x in out]
        return out

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fits of whole series, which come one after another."""
        ready, count = [], 0
        for name, parts in itertools.groupby(gathered(batches, True), lambda x: x[0][0]):
            scalars, sums = [], []
            for _, (j0, low, step, n), samples in parts:
                one, total = summed(*samples, low, step, n)
                scalars.append(one)
                sums.append(total)
            ready.append(made(name, (j0, low, step), 0, scalars, sums))
            count += len(ready[-1][0])
            if count > 1 << 16 or len(ready) > 1000:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*ready, strict=True)], told.names)
                ready, count = [], 0
        if ready:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*ready, strict=True)], told.names)

    def united(table: pa.Table) -> pa.Table:
        """Fits of some frequencies of a long series, from the sums of all tasks."""
        held = {}
        for i in range(table.num_rows):
            key = tuple(table.column(n)[i].as_py() for n in names)
            own = np.array([table.column(n)[i].as_py() for n in plain]), np.stack([table.column(f"{n}c")[i].values.to_numpy() + 1j * table.column(f"{n}s")[i].values.to_numpy() for n in waves])
            held[key] = tuple(a + b for a, b in zip(held[key], own, strict=True)) if key in held else own
        first = {n: table.column(n)[0].as_py() for n in ("series_id", "j0_", "off_", "low_", "step_")}
        place = (first["j0_"] - first["off_"], first["low_"], first["step_"])
        return pa.Table.from_arrays(made(first["series_id"], place, first["off_"], *zip(*held.values(), strict=True)), told.names)

    parts_of = [f"{n}{x}" for n in waves for x in "cs"]
    plain = ["n0", "sy", "syy", "uu", "uy", "points"]
    fields = [*names, "j0_", "off_", "low_", "step_", *plain, *parts_of]
    schema = T.StructType([name_types[n] for n in names])
    kinds = [to_arrow_type(name_types[n].dataType) for n in names]
    for n in ("j0_", "off_", "low_", "step_", *plain):
        schema = schema.add(n, "long" if n in ("j0_", "off_") else "double")
    for n in parts_of:
        schema = schema.add(n, T.ArrayType(T.DoubleType()))
    def sums(rows: DataFrame, whole: bool) -> DataFrame:
        parts = rows.mapInArrow(lambda batches: add(batches, whole), schema)
        each = parts.select(*names, "j0_", "off_", "low_", "step_", *plain, F.posexplode(F.arrays_zip(*parts_of)).alias("at_", "z_"))
        each = each.withColumn("j", F.col("j0_") + F.col("at_") + F.lit(0).cast("long")).withColumn("f", F.col("low_") + F.col("step_") * (F.col("off_") + F.col("at_")))
        return each.select(*names, "j", "f", *plain, *[F.col("z_")[n].alias(n) for n in parts_of])

    # small series meet in one task each, so that no sums are shuffled, whose number is that of their frequencies, not points
    done = []
    if small is not None:
        small = by_series(small).sortWithinPartitions(*names)
    if fit is None:
        if small is not None:
            done.append(sums(small, True))
        if long is not None:
            done.append(sums(long, False).groupBy(*names, "j", "f").agg(*[F.sum(n).alias(n) for n in (*plain, *parts_of)]))
        return functools.reduce(DataFrame.unionByName, done)
    told = T.StructType([name_types["series_id"]]).add("j", "long").add("f", "double")
    for n in fit.columns:
        told = told.add(n, "double")
    if small is not None:
        done.append(small.mapInArrow(fitted, told))
    if long is not None:
        large = long.mapInArrow(lambda batches: add(batches, False), schema).groupBy("series_id", "off_").applyInArrow(united, told)
        if fit.least:
            best = F.min_by(F.struct(*told.names[1:]), F.struct(fit.least, "j"))
            large = large.groupBy("series_id").agg(best.alias("b")).select("series_id", "b.*")
        done.append(large)
    return functools.reduce(DataFrame.unionByName, done)


def _spectrum(series: DataFrame | Samples, grid: DataFrame, b: Baseline, columns: tuple[str, ...], least: str | None = None) -> DataFrame:
    """By series_id, j and f the named columns of ``_sinusoid`` beside a baseline."""
    keys, waves = ((b.night,) if b.night else ()), {"w": (0, 1), "y": (1, 1), "d": (0, 2)}
    if b.slopes:
        waves |= {"u": (2, 1)}
        series = series if isinstance(series, Samples) else series.withColumn("u0_", _night_slopes(series, b))
    fit = Fit(columns, lambda plain, sums: _sinusoid(plain, sums, b, columns), least)
    return _summed(series, grid, keys, b.w, F.col("u0_") if b.slopes else None, waves, fit)


def _sinusoid(plain: np.ndarray, sums: np.ndarray, b: Baseline, wanted: tuple[str, ...]) -> list[pa.Array]:
    """Fits of a sinusoid beside a baseline at each frequency, from sums by night: psd (half the gain), power, s_coeff, c_coeff, rss and the
    covariance, as ``centred`` and ``solved`` have them."""
    n0, sy, syy, uu, uy, points = plain.T[:, :, None]
    w, y, d = sums[:, 0], sums[:, 1], sums[:, 2]
    own = {"s": w.imag, "c": w.real, "y": sy}
    both = {"ss": (n0 - d.real) / 2, "cc": (n0 + d.real) / 2, "sc": d.imag / 2, "ys": y.imag, "yc": y.real, "yy": syy}
    with np.errstate(all="ignore"):
        if b.offsets:
            both = {k: v - own[k[0]] * own[k[1]] / n0 for k, v in both.items()}
        if b.slopes:
            tilt = {"s": sums[:, 3].imag, "c": sums[:, 3].real, "y": uy}
            both = {k: v - np.where(uu > 0, tilt[k[0]] * tilt[k[1]] / uu, 0.0) for k, v in both.items()}
        a, e, x, p, q, r = (both[k].sum(0) for k in ("ss", "cc", "sc", "ys", "yc", "yy"))
        det = a * e - x * x
        ok = det > 1e-12 * np.maximum(a * e, 1e-300)
        s, c = (e * p - x * q) / det, (a * q - x * p) / det
        # one of the two columns is all there is when they are proportional
        single = np.maximum(np.maximum(np.where(a != 0, p * p / a, 0.0), np.where(e != 0, q * q / e, 0.0)), 0.0)
        gain = np.where(ok, s * p + c * q, single)
        rss = r - gain
        columns = 2 + len(plain) * ((int(b.offsets) + int(b.slopes)) if b.night else 1)
        variance = np.maximum(rss, 0.0) / max(points.sum() - columns, 1.0)
        values = {"psd": gain / 2, "power": np.maximum(gain / np.maximum(r, 1e-30), 0.0), "rss": rss, "s_coeff": s, "c_coeff": c, "cov_ss": e / det * variance, "cov_sc": -x / det * variance, "cov_cc": a / det * variance}
    return [pa.array(values[n], mask=None if n in ("psd", "power", "rss") else ~ok) for n in wanted]


def lomb_scargle(series: DataFrame | Samples, grid: DataFrame, weight: Column | None = None) -> DataFrame:
    """Floating-mean periodogram, psd normalisation: half the drop of the residual sum of squares."""
    if isinstance(series, Samples):
        weight = None
    if weight is not None:
        series = series.withColumn("w0_", weight)
    return _spectrum(series, grid, Baseline(weight=None if weight is None else "w0_"), ("psd",)).withColumnRenamed("psd", "power")


def _night_slopes(series: DataFrame, b: Baseline) -> Column:
    """Time from the night's mean: the weighted one beside offsets, so that both are orthogonal."""
    w, night = b.w, by("series_id", b.night)
    if "y" in series.columns:  # a point without a value is in no fit
        w = F.when(F.col("y").isNotNull() & F.col("t").isNotNull(), w)
    mean = F.sum(w * F.col("t")).over(night) / F.nullif(F.sum(w).over(night), F.lit(0.0)) if b.offsets else F.avg("t").over(night)
    return F.coalesce(F.col("t") - mean, F.lit(0.0))


def nuisance_periodogram(series: DataFrame | Samples, grid: DataFrame, baseline: Baseline | str | None = None, slopes: bool = False) -> DataFrame:
    """Share of the weighted residual sum of squares that a sinusoid removes beside a baseline, with the fit (s_coeff, c_coeff,
    rss) and the covariance of both coefficients (cov_ss, cov_sc, cov_cc).

    The baseline is block diagonal, so each night's weighted means and slopes are projected off its own sums, and the nights'
    rests are added: the normal equations of two coefficients for each frequency, whatever the number of nights. The covariance
    is their inverse times rss over the degrees of freedom (points less all columns, one at least). A night's mean time is
    taken from the samples, before they meet the grid."""
    b = Baseline.of(baseline, slopes)
    return _spectrum(series, grid, b, _FIT)


#: Columns of a fit.
_FIT = ("power", "s_coeff", "c_coeff", "rss", "cov_ss", "cov_sc", "cov_cc")


def with_errors(fits: DataFrame) -> DataFrame:
    """Adds amp, amp_err, phase and phase_err of fits with their covariance."""
    s, c, cov = F.col("s_coeff"), F.col("c_coeff"), [F.col(x) for x in ("cov_ss", "cov_sc", "cov_cc")]
    return fits.withColumns({"amp": amplitude(s, c), "amp_err": amplitude_error(s, c, *cov), "phase": phase(s, c), "phase_err": phase_error(s, c, *cov)})


def spectral_window(series: DataFrame, grid: DataFrame) -> DataFrame:
    sums = wave_sums(series.withColumn("y", F.lit(1.0)), grid)
    z = F.col("ss") * F.col("ss") + F.col("sc") * F.col("sc")
    return sums.withColumn("z", z).select("series_id", "j", "f", (F.col("z") / F.max("z").over(by())).alias("power"))


def noise_floor(spectrum: DataFrame, spans: DataFrame, span: str = "t_full", ks: float = SIDES, kfit: float = KFIT, side_bins: int = SIDE_BINS, trim: float = TRIM, value: str = "power") -> DataFrame:
    """``spectrum`` with ``noise``: for every bin the trimmed median of the bins on both sides, beyond a guard of ``kfit`` 2 / T and up to
    max(``ks`` / T, ``side_bins`` steps) from it; where that is no positive number, that of the whole spectrum. Null for
    a spectrum of fewer than 5 bins or without a span.

    A task has a block of bins with a halo as wide as the windows, so about one row a bin is shuffled, and moves a sorted
    window along: each bin enters and leaves it twice."""
    ends = spectrum.groupBy("series_id").agg(F.count("*").alias("bins_"), F.min("f").alias("fa_"), F.max("f").alias("fb_"), F.min("j").alias("ja_"), F.max("j").alias("jb_"))
    t = F.when(F.col(span) > 0, F.col(span))
    step = (F.col("fb_") - F.col("fa_")) / F.nullif(F.col("jb_") - F.col("ja_"), F.lit(0))
    guard = F.lit(kfit) * (F.lit(2.0) / t)
    told = ends.join(spans.select("series_id", span), "series_id").filter((F.col("bins_") >= 5) & t.isNotNull()).withColumns({"step_": step, "guard_": guard})
    told = told.withColumn("side_", F.greatest(F.lit(ks) * (F.lit(1.0) / t), F.lit(float(side_bins)) * F.col("step_")))
    told = told.withColumn("reach_", F.ceil((F.col("guard_") + F.col("side_")) / F.col("step_")) + 1).select("series_id", "guard_", "side_", "reach_")
    size = _NOISE_BLOCK
    block = lambda x: F.floor(x / F.lit(size)).cast("long")
    rows = spectrum.select("series_id", "j", "f", F.col(value).cast("double").alias("p_")).join(told, "series_id")
    rows = rows.withColumn("block", F.explode(F.sequence(block(F.col("j") - F.col("reach_")), block(F.col("j") + F.col("reach_"))))).drop("reach_")

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j", ignore_index=True)
        own = np.flatnonzero(pdf["j"].to_numpy() // size == pdf["block"].iloc[0])
        out = pdf.iloc[own][["series_id", "j"]].copy()
        out["local"] = _sliding_medians(pdf["f"].to_numpy(), pdf["p_"].to_numpy(float), own, pdf["guard_"].iloc[0], pdf["side_"].iloc[0], trim)
        return out

    kind = spectrum.schema["series_id"].dataType.simpleString()
    local = rows.groupBy("series_id", "block").applyInPandas(slide, f"series_id {kind}, j long, local double")
    whole = trimmed_median(spectrum, value, trim).withColumnRenamed("trimmed", "whole")
    out = spectrum.join(local, ["series_id", "j"], "left").join(whole.join(told.select("series_id"), "series_id"), "series_id", "left")
    return out.withColumn("noise", F.when(F.col("local") > 0, F.col("local")).otherwise(F.col("whole"))).drop("local", "whole")


#: Bins of a block of ``noise_floor``.
_NOISE_BLOCK = 8192


def _sliding_medians(f: np.ndarray, p: np.ndarray, own: np.ndarray, guard: float, side: float, trim: float) -> np.ndarray:
    """Trimmed medians of p in [f0 - guard - side, f0 - guard] and [f0 + guard, f0 + guard + side] for the bins ``own``."""
    at, ok, held = f[own], np.isfinite(p), []
    left, low = np.searchsorted(f, at - (guard + side), "left"), np.searchsorted(f, at - guard, "right")
    high, right = np.searchsorted(f, at + guard, "left"), np.searchsorted(f, at + (guard + side), "right")
    high = np.maximum(high, low)
    now, out = (0, 0, 0, 0), np.full(len(own), np.nan)
    for i, new in enumerate(zip(left.tolist(), low.tolist(), high.tolist(), right.tolist(), strict=True)):
        if i == 0:
            held = sorted(p[k] for k in [*range(new[0], new[1]), *range(new[2], new[3])] if ok[k])
        else:
            for k in [*range(now[1], new[1]), *range(now[3], new[3])]:
                if ok[k]:
                    insort(held, p[k])
            for k in [*range(now[0], new[0]), *range(now[2], new[2])]:
                if ok[k]:
                    del held[bisect_left(held, p[k])]
        now = new
        if held:
            k = min(max(math.floor((1.0 - trim) * len(held)), 1), len(held))
            out[i] = (held[(k - 1) // 2] + held[k // 2]) / 2
    return out


def annulus_noise(spectrum: DataFrame, at: DataFrame, guard: Column, side: Column, least: int = 12, trim: float = 0.1) -> DataFrame:
    """(series_id, noise, n): trimmed median between guard and guard + width of f0, the width 1.5 times wider up to five
    times until ``least`` points give a positive value. All widths in one pass."""
    rows = spectrum.join(at, "series_id").withColumn("away", F.abs(F.col("f") - F.col("f0")))
    widths = F.array(*[F.when((F.col("away") >= guard) & (F.col("away") <= guard + 1.5**k * side), F.lit(k)) for k in range(6)])
    rows = rows.filter("power is not null").withColumn("k_", F.explode(F.filter(widths, lambda k: k.isNotNull())))
    w = by("series_id", "k_")
    ranked = rows.withColumn("r_", F.row_number().over(w.orderBy("power"))).withColumn("n_", F.count("*").over(w))
    kept = ranked.filter(F.col("r_") <= F.greatest(F.lit(1), F.floor((1 - trim) * F.col("n_"))))
    per = kept.groupBy("series_id", "k_").agg(F.median("power").alias("noise"), F.max("n_").alias("n")).filter((F.col("noise") > 0) & (F.col("n") >= least))
    return per.groupBy("series_id").agg(F.min_by(F.struct("noise", "n"), "k_").alias("b")).select("series_id", "b.*")


def whitened(spectrum: DataFrame, spans: DataFrame, span: str = "t_full", ks: float = SIDES, kfit: float = KFIT, side_bins: int = SIDE_BINS) -> DataFrame:
    """``spectrum`` with noise and ``white``, the power over the noise."""
    noisy = noise_floor(spectrum, spans, span, ks, kfit, side_bins)
    return noisy.withColumn("white", F.when(F.col("noise") > 0, F.col("power") / F.nullif(F.col("noise"), F.lit(0.0))))


def strongest(spectrum: DataFrame, value: str = "power") -> DataFrame:
    """(series_id, j, f, value) of the largest value, the lowest frequency among equals."""
    best = F.max_by(F.struct("j", "f", value), F.struct(F.col(value), -F.col("j")))
    return spectrum.groupBy("series_id").agg(best.alias("b")).select("series_id", "b.*")


def normalised(spectrum: DataFrame, value: str = "power") -> DataFrame:
    """Over the 99th percentile, else the maximum, else 1."""
    p = F.percentile(value, F.lit(0.99)).over(by())
    m = F.max(value).over(by())
    return spectrum.withColumn("norm", F.col(value) / F.when(p > 0, p).when(m > 0, m).otherwise(F.lit(1.0)))


def _peaks(y: np.ndarray) -> np.ndarray:
    """Local maxima; of a flat one, with lower points on both sides, the middle (the earlier of two)."""
    if len(y) < 3:
        return np.zeros(0, np.int64)
    first = np.r_[0, np.flatnonzero(y[1:] != y[:-1]) + 1]  # where runs of equal values begin
    last, top = np.r_[first[1:] - 1, len(y) - 1], y[first]
    inner = np.flatnonzero((top[1:-1] > top[:-2]) & (top[1:-1] > top[2:])) + 1 if len(first) > 2 else np.zeros(0, np.int64)
    return (first[inner] + last[inner]) // 2


def _lowest_before_higher(y: list[float]) -> list[float]:
    """For each point the lowest one from itself back to the last higher one: a stack of ever lower points, each with the lowest
    since the one under it, so every point is put on and taken off once."""
    stack, out = [], []
    for v in y:
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        stack.append((v, low))
        out.append(low)
    return out


def prominences(spectrum: DataFrame, value: str = "power") -> DataFrame:
    """Local maxima with their prominence: to each side the lowest point before a higher one, or the end; the peak minus
    the higher of both. Nulls are lower than everything. One pass over a series' bins in each direction."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j", ignore_index=True)
        y = pdf[value].to_numpy(float)
        y = np.where(np.isnan(y), -np.inf, y)
        peaks = _peaks(y)
        left, right = np.array(_lowest_before_higher(y.tolist())), np.array(_lowest_before_higher(y[::-1].tolist()))[::-1]
        found = pdf.iloc[peaks][["series_id", "j", "f", value]].copy()
        found["prominence"] = y[peaks] - np.maximum(left[peaks], right[peaks]) if len(peaks) else np.zeros(0)
        return found

    kind = spectrum.schema["series_id"].dataType.simpleString()
    return spectrum.select("series_id", "j", "f", value).groupBy("series_id").applyInPandas(walk, f"series_id {kind}, j long, f double, {value} double, prominence double")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _stay(values: pd.Series, min_sep: pd.Series) -> pd.Series:
    out = []
    for row, sep in zip(values, min_sep, strict=True):
        kept, flags = [], []
        for x in row:
            at = bisect(kept, x)
            flags.append((at == 0 or x - kept[at - 1] >= sep) and (at == len(kept) or kept[at] - x >= sep))
            if flags[-1]:
                kept.insert(at, x)
        out.append(flags)
    return pd.Series(out)


def spaced(peaks: DataFrame, order: list, min_sep: float | Column, f: str = "f") -> DataFrame:
    """Greedy choice in ``order``: a row stays if it is ``min_sep`` (a number, or a column that is one value a series) or more
    from all that stayed. Runs over one array of candidates a series; a walk that looks at the nearest that stayed on either side."""
    names = peaks.columns
    ranked = peaks.withColumn("rank_", F.row_number().over(by().orderBy(*order))).withColumn("sep_", min_sep if isinstance(min_sep, Column) else F.lit(float(min_sep)))
    rows = F.sort_array(F.collect_list(F.struct("rank_", *names)))
    grouped = ranked.groupBy(F.col("series_id").alias("key_")).agg(rows.alias("rows_"), F.max("sep_").alias("sep_"))
    flagged = grouped.withColumn("stay_", _stay(F.transform("rows_", lambda r: r[f].cast("double")), F.col("sep_")))
    return flagged.select(F.inline(F.filter("rows_", lambda r, i: F.get("stay_", i)))).drop("rank_")


def top_peaks(spectrum: DataFrame, k: int, min_sep: float | Column, min_prominence: float = 1.0, value: str = "power", sep: DataFrame | None = None) -> DataFrame:
    """The ``k`` highest peaks that are ``min_sep`` apart (higher ones first) and of enough prominence; ``sep``: a table (series_id,
    sep) that ``min_sep`` names."""
    found = prominences(spectrum, value)
    found = found if sep is None else found.join(sep, "series_id")
    kept = spaced(found, [F.desc(value), "j"], min_sep).filter(F.col("prominence") >= min_prominence)
    rank = F.row_number().over(by().orderBy(F.desc(value), F.desc("prominence"), "j"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k)


def excluded(spectrum: DataFrame, accepted: DataFrame, half: float | Column) -> DataFrame:
    """Spectrum without bins within ``half`` (a number, or a column of ``spectrum``) of an accepted frequency (series_id, f)."""
    taken = accepted.groupBy("series_id").agg(F.collect_list("f").alias("taken_"))
    free = F.coalesce(F.forall("taken_", lambda x: F.abs(F.col("f") - x) > half), F.lit(True))
    return spectrum.join(taken, "series_id", "left").filter(free).drop("taken_")


def frequency_fit(series: DataFrame | Samples, centres: DataFrame, half: Column, fmin: float, fmax: float, steps: int = 1001, baseline: Baseline | str | None = None, bounds: tuple[str, str] | None = None) -> DataFrame:
    """The frequency of least residual among ``steps`` even ones (11 at least) around f0: series_id, f, s_coeff, c_coeff, rss, power
    and the covariance; ``bounds`` names columns of ``centres`` that the frequency keeps within. Where no range is left, half of
    it around f0 is tried."""
    steps = max(11, steps)

    def within(reach: Column) -> tuple[Column, Column]:
        low, high = F.greatest(F.lit(fmin), F.col("f0") - reach), F.least(F.lit(fmax), F.col("f0") + reach)
        return (F.greatest(low, F.col(bounds[0])), F.least(high, F.col(bounds[1]))) if bounds else (low, high)

    (low, high), (near, far) = within(half), within(0.5 * half)
    none = high <= low
    own = centres.select("series_id", F.lit(0).cast("long").alias("j0_"), F.when(none, near).otherwise(low).alias("low_"), F.when(none, far).otherwise(high).alias("high_"), F.lit(steps).cast("long").alias("n_"))
    return _spectrum(series, own, Baseline.of(baseline), _FIT, "rss").drop("j")


def prewhitened(series: DataFrame, fits: DataFrame, y: str = "y", baseline: Baseline | str | None = None) -> DataFrame:
    """y without the fitted sinusoid and baseline; series without a fit stay as they are."""
    b = Baseline.of(baseline)
    own = fits.select("series_id", F.col("f").alias("f_"), F.col("s_coeff").alias("s_"), F.col("c_coeff").alias("c_"))
    joined = series.join(own, "series_id", "left")
    angle = TAU * F.col("f_") * F.col("t")
    wave = F.coalesce(F.col("s_") * F.sin(angle) + F.col("c_") * F.cos(angle), F.lit(0.0))
    joined = joined.withColumn("rest_", F.col(y) - wave)
    keys, rest = ["series_id", *([b.night] if b.night else [])], F.col("rest_")
    group = by(*keys)
    if b.offsets:  # one mean a series or night, from an aggregate: no window has to hold a long series
        mean = F.sum(b.w * rest) / F.nullif(F.sum(F.when(rest.isNotNull(), b.w)), F.lit(0.0))
        means = joined.filter("f_ is not null").groupBy(*[F.col(k).alias(f"{k}_m") for k in keys]).agg(mean.alias("mean_"))
        same = [F.col(k).eqNullSafe(F.col(f"{k}_m")) for k in keys]
        joined = joined.join(F.broadcast(means), same, "left").drop(*[f"{k}_m" for k in keys])
    fitted = F.coalesce("mean_", F.lit(0.0)) if b.offsets else F.lit(0.0)
    if b.slopes:
        joined = joined.withColumn("u0_", _night_slopes(series, b))
        ratio = F.sum(b.w * F.col("u0_") * rest).over(group) / F.nullif(F.sum(b.w * F.col("u0_") * F.col("u0_")).over(group), F.lit(0.0))
        fitted = fitted + F.coalesce(ratio, F.lit(0.0)) * F.col("u0_")
    return joined.withColumn(y, rest - F.when(F.col("f_").isNotNull(), fitted).otherwise(F.lit(0.0))).select(*series.columns)
