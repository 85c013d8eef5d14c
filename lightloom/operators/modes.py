"""Mode extraction: loops of Spark jobs over all series in step. Each round writes what it leaves to a scratch table; the
driver sees only how many series go on."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.waves import amplitude, combined_power, dataset_weight, period, phase, sinusoid
from ..tables import discard, stored
from .regress import pseudo_solved
from .series import by, clean, longest_chunk
from .spectrum import KFIT, SIDE_BINS, SIDES, TAU, WHOLE, Baseline, Samples, _groups, _night_slopes, annulus_noise, by_series, excluded, frequency_fit, frequency_grid, harmonic_fit, harmonic_power, harmonic_wave, local_grid, lomb_scargle, nuisance_periodogram, packed_samples, prewhitened, spaced, strongest, top_peaks, whitened, with_errors

#: Modes closer than this many resolution elements are one; a found mode's surroundings of as many are not searched again.
SEPARATION = 5.0
#: Sides of noise windows of nightly series, in 1 / T; of guided searches, in 1 / T and bins.
NIGHT_SIDES = 10.0
GUIDED_SIDES, GUIDED_SIDE_BINS = 3.0, 6


def _span(t: str | Column) -> Column:
    return F.greatest(F.col(t) if isinstance(t, str) else t, F.lit(1e-8))


def _bins(grid: DataFrame) -> DataFrame:
    """(series_id, bin_): the step of each series' even grid."""
    return grid.groupBy("series_id").agg(((F.max("f") - F.min("f")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("bin_"))


def snr_at(spectrum: DataFrame, at: DataFrame, guard: Column, side: Column) -> DataFrame:
    """(series_id, snr, w): power of the nearest bin over the trimmed median of sidebands (else of all outside the guard,
    else of all); at: series_id, f0 and what guard and side need."""
    rows = spectrum.join(at, "series_id").withColumn("away", F.abs(F.col("f") - F.col("f0")))
    f, f0 = F.col("f"), F.col("f0")
    beside = ((f >= f0 - (guard + side)) & (f <= f0 - guard)) | ((f >= f0 + guard) & (f <= f0 + (guard + side)))
    kinds = F.array(F.when(beside, F.lit(0)), F.when(F.col("away") >= guard, F.lit(1)), F.lit(2))
    ranked = rows.filter("power is not null").withColumn("kind", F.explode(kinds)).filter("kind is not null")
    w = by("series_id", "kind")
    ranked = ranked.withColumn("r_", F.row_number().over(w.orderBy("power"))).withColumn("n_", F.greatest(F.lit(1), F.floor(0.9 * F.count("*").over(w))))
    noise = ranked.filter("r_ <= n_").groupBy("series_id", "kind").agg(F.median("power").alias("noise")).filter("noise > 0")
    noise = noise.groupBy("series_id").agg(F.min_by("noise", "kind").alias("noise"))
    here = rows.groupBy("series_id").agg(F.min_by("power", F.struct("away", "j")).alias("p0"))
    out = here.join(noise, "series_id", "left").withColumn("w", F.col("p0") / F.col("noise"))
    return out.select("series_id", F.when(F.col("w") > 0, F.sqrt("w")).alias("snr"), "w")


def snr_after_fit(series: DataFrame | Samples, fits: DataFrame, spans: DataFrame, fmin: float, fmax: float, span: str = "t_full", nightly: bool = False, ks: float | None = None, baseline: Baseline | str | None = None) -> DataFrame:
    """(series_id, snr, w) from a local spectrum around f, in steps of 1 / (5 T): the largest power inside the guard over the noise
    of the annulus. The guard is ``KFIT`` 2 / T, 2 / T (``nightly``: 3 / T) at least; sides are ``ks`` / T, 4 / T (6 / T) at least."""
    guard_bins, side_bins, most = (3.0, 6.0, 1601) if nightly else (2.0, 4.0, 1201)
    ks = (NIGHT_SIDES if nightly else SIDES) if ks is None else ks
    t = _span(span)
    at = fits.select("series_id", F.col("f").alias("f0")).join(spans.select("series_id", (1.0 / t).alias("res_"), F.greatest(KFIT * (2.0 / t), guard_bins * (1.0 / t)).alias("guard_")), "series_id")
    side = F.greatest(F.lit(ks) * F.col("res_"), F.lit(side_bins) * F.col("res_"))
    grid = local_grid(at, F.col("guard_") + side, F.greatest(F.col("res_") / 5, F.lit(1e-8)), fmin, fmax, most).select("series_id", "j", "f")
    b = Baseline.of(baseline)
    power = nuisance_periodogram(series, grid, b).select("series_id", "j", "f", "power") if nightly else lomb_scargle(series, grid, b.w)
    power = stored(power, "local")
    rows = power.join(at, "series_id").withColumn("away", F.abs(F.col("f") - F.col("f0")))
    peak = rows.groupBy("series_id").agg(F.coalesce(F.max(F.when(F.col("away") <= F.col("guard_"), F.col("power"))), F.min_by("power", F.struct("away", "j"))).alias("p0"))
    out = peak.join(annulus_noise(power, at, F.col("guard_"), side), "series_id", "left").withColumn("w", F.col("p0") / F.col("noise"))
    return out.select("series_id", F.when(F.col("w") > 0, F.sqrt("w")).alias("snr"), "w")


def sequential_modes(series: DataFrame, fmin: float, fmax: float, rounds: int = 20, snr_stop: float = 4.0, most: int = 60_000, steps: int = 1001, kfit: float = KFIT, weight: str | None = None) -> DataFrame:
    """(series_id, mode, f, amp, phase, snr, w): strongest peak, fit, test, prewhiten, until a series' peak is too weak.
    No peak is taken within max(``SEPARATION`` / T, a grid step) of a mode that was found before. ``weight`` names the column of
    the points' weights."""
    spans = stored(longest_chunk(series), "spans")
    grid = stored(frequency_grid(spans, fmin, fmax, most=most), "grid")
    spans = stored(spans.join(_bins(grid), "series_id"), "spans")
    b = Baseline(weight=weight)
    left, found = packed_samples(series, b), None
    chunk = _span("t_chunk")
    guard, side = kfit * (2.0 / chunk), F.greatest(SIDES * (1.0 / chunk), SIDE_BINS * F.col("bin_"))
    for mode in range(1, rounds + 1):
        spectrum = stored(lomb_scargle(left, grid, b.w), "spectrum")
        free = spectrum
        if found is not None:
            reach = spans.select("series_id", F.greatest(SEPARATION / _span("t_full"), "bin_").alias("reach_"))
            free = excluded(spectrum.join(reach, "series_id"), found.select("series_id", "f"), F.col("reach_")).drop("reach_")
        start = strongest(free).select("series_id", F.col("f").alias("f0")).join(spans, "series_id")
        fits = stored(frequency_fit(left, start, kfit * 2.0 / F.col("t_full"), fmin, fmax, steps, b), "fits")
        at = fits.select("series_id", F.col("f").alias("f0")).join(spans, "series_id")
        tested = fits.join(snr_at(spectrum, at, guard, side), "series_id", "left")
        amp, phi = amplitude(F.col("s_coeff"), F.col("c_coeff")), phase(F.col("s_coeff"), F.col("c_coeff"))
        kept = stored(tested.filter(F.col("snr") >= snr_stop).select("series_id", F.lit(mode).alias("mode"), "f", "s_coeff", "c_coeff", amp.alias("amp"), phi.alias("phase"), "snr", "w"), "modes")
        if kept.isEmpty():
            break
        former = left
        found = kept if found is None else stored(found.unionByName(kept), "modes")
        left = left.less(kept, only=True)
        former.discard()
        for done in (spectrum, fits):
            discard(done)
    return kept if found is None else found


def deduped(modes: DataFrame, min_sep: float | Column) -> DataFrame:
    """Best first (the largest of snr, amp, w and 0; lower f among equals), each ``min_sep`` from those before."""
    score = F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c in ("snr", "amp", "w")])
    return spaced(modes.withColumn("score_", score), [F.desc("score_"), "f"], min_sep).drop("score_")


def collapsed(modes: DataFrame, min_sep: float | Column) -> DataFrame:
    """Chains of modes closer than ``min_sep`` to the one before become their largest."""
    w = by().orderBy("f", "mode")
    chain = F.sum(F.when(F.col("f") - F.lag("f").over(w) >= min_sep, 1).otherwise(0)).over(w)
    best = F.max_by(F.struct(*[c for c in modes.columns if c != "series_id"]), F.struct("amp", -F.col("f")))
    return modes.withColumn("chain_", chain).groupBy("series_id", "chain_").agg(best.alias("b")).select("series_id", "b.*")


def merged_peaks(tables: list[DataFrame], min_sep: float | Column) -> DataFrame:
    """Tables (series_id, f, height) in order of priority, each peak ``min_sep`` from those before."""
    every = None
    for k, t in enumerate(tables):
        t = t.withColumn("source", F.lit(k))
        every = t if every is None else every.unionByName(t)
    return spaced(every, ["source", F.desc("height"), "f"], min_sep)


def matched(local: DataFrame, components: DataFrame) -> DataFrame:
    """Local modes in order, each with the closest component that is left: a small walk over one array a series."""
    own = local.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("mode", "f"))).alias("own_"))
    other = components.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("f", "amp", "phase"))).alias("rest_"))
    both = own.join(other, "series_id", "left").withColumn("rest_", F.coalesce("rest_", F.array().cast("array<struct<f:double,amp:double,phase:double>>")))
    kind = "array<struct<mode:int,f_local:double,f:double,amp:double,phase:double>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.col("rest_").alias("rest"))

    def step(state: Column, m: Column) -> Column:
        away = F.transform(state["rest"], lambda c, i: F.struct(F.abs(c["f"] - m["f"]).alias("d"), i.alias("i")))
        at = F.array_min(away)["i"]
        pick = F.get(state["rest"], at)
        row = F.struct(m["mode"].cast("int").alias("mode"), m["f"].alias("f_local"), pick["f"].alias("f"), pick["amp"].alias("amp"), pick["phase"].alias("phase"))
        rest = F.when(F.size(state["rest"]) > 0, F.filter(state["rest"], lambda c, i: i != at)).otherwise(state["rest"])
        return F.struct(F.concat(state["done"], F.array(row).cast(kind)).alias("done"), rest.alias("rest"))

    return both.select("series_id", F.inline(F.aggregate("own_", zero, step)["done"]))


def _mode_fits(series: DataFrame, modes: DataFrame, most: int, slopes: bool, b: Baseline) -> DataFrame:
    """(series_id, beta, rss): all waves of a series at once (with ``slopes`` also their slopes in frequency), beside the baseline.

    Tasks turn samples into one matrix of sums of products a series and night, of the baseline's columns too, and the baseline is
    projected off the sums; no sample is shuffled with its waves. Series of ``WHOLE`` points at most meet in one task each, of
    longer ones each task gives its own sums."""
    own = F.struct("mode", F.col("f").cast("double").alias("f"), *([F.coalesce(c, F.lit(0.0)).alias(c) for c in ("s_coeff", "c_coeff")] if slopes else []))
    packed = modes.groupBy("series_id").agg(F.sort_array(F.collect_list(own)).alias("m_"))
    part = lambda c: F.transform("m_", lambda m: m[c]).alias(f"{c}_")
    packed = packed.select("series_id", *[part(c) for c in ("f", *(("s_coeff", "c_coeff") if slopes else ()))])
    rows = series.withColumn("u_", _night_slopes(series, b) if b.slopes else F.lit(0.0)).withColumn("w_", b.w)
    keys = ("series_id", *([b.night] if b.night else []))
    rows = rows.select(*keys, F.col("t").cast("double"), F.col("y").cast("double"), "u_", "w_").filter("t is not null and y is not null and w_ > 0")
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("size_"))
    rows = rows.join(packed.join(sizes, "series_id"), "series_id")
    first = int(b.offsets) + int(b.slopes)
    wide = first + (3 if slopes else 2) * most + 1

    def products(own: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
        t, y, u, w = (own.column(c).to_numpy(zero_copy_only=False)[at] for c in ("t", "y", "u_", "w_"))
        f, *coeff = (np.array(own.column(c)[int(at[0])].as_py(), float) for c in (["f_", "s_coeff_", "c_coeff_"] if slopes else ["f_"]))
        angle = TAU * np.outer(t, f)
        sin, cos = np.sin(angle), np.cos(angle)
        x, each = np.zeros((len(t), wide)), 3 if slopes else 2
        if b.offsets:
            x[:, 0] = 1.0
        if b.slopes:
            x[:, first - 1] = u
        end = first + each * len(f)
        x[:, first:end:each], x[:, first + 1 : end : each] = sin, cos
        if slopes:
            x[:, first + 2 : end : each] = TAU * t[:, None] * (coeff[0] * cos - coeff[1] * sin)
        x[:, -1] = y
        return (x * w[:, None]).T @ x

    def parts(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[tuple, np.ndarray]]:
        held = {}
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for n in keys:
                of = pc.dictionary_encode(batch.column(n), null_encoding="encode")
                code = code * (len(of.dictionary) + 1) + of.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else []
            for at in sorted(groups, key=lambda at: at[0]):
                key, total = tuple(batch.column(n)[int(at[0])].as_py() for n in keys), products(batch, at)
                held[key] = held[key] + total if key in held else total
            last = next(reversed(held))[0] if held else None
            if whole or len(held) * wide * wide > 1 << 22:
                for key in [k for k in held if not (whole and k[0] == last)]:
                    yield key, held.pop(key)
        yield from held.items()

    def solved(sums: Iterator[tuple[tuple, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Of consecutive matrices of each series."""
        out = []
        for name, nights in itertools.groupby(sums, lambda x: x[0][0]):
            total = np.zeros((wide - first, wide - first))
            for _, m in nights:
                for i in range(first):
                    if m[i, i] > 0:
                        m = m - np.outer(m[i], m[i]) / m[i, i]  # noqa: PLW2901
                total = total + m[first:, first:]
            xx, xy, yy = total[:-1, :-1], total[:-1, -1], total[-1, -1]
            beta = pseudo_solved(xx, xy)
            out.append((name, beta, max(float(yy - beta @ xy), 0.0)))
            if len(out) >= 1000:
                yield told(out)
                out = []
        if out:
            yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from solved(parts(batches, True))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, m in parts(batches, False):
            columns = [pa.array([v], kind) for v, kind in zip(key, key_kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel()], pa.list_(pa.float64()))], [*keys, "sums"])

    def united(table: pa.Table) -> pa.Table:
        """One long series: the matrices of all tasks, night by night."""
        sums = {}
        for i in range(table.num_rows):
            key = tuple(table.column(n)[i].as_py() for n in keys)
            own = np.array(table.column("sums")[i].as_py(), float).reshape(wide, wide)
            sums[key] = sums[key] + own if key in sums else own
        return pa.Table.from_batches(list(solved(iter(sums.items()))))

    schema = T.StructType([rows.schema["series_id"]]).add("beta", T.ArrayType(T.DoubleType())).add("rss", "double")
    kinds, key_kinds = [to_arrow_type(x.dataType) for x in schema], [to_arrow_type(rows.schema[n].dataType) for n in keys]
    small = by_series(rows.filter(F.col("size_") <= WHOLE)).sortWithinPartitions(*keys).mapInArrow(whole, schema)
    sums = rows.filter(F.col("size_") > WHOLE).mapInArrow(partial, T.StructType([rows.schema[n] for n in keys]).add("sums", T.ArrayType(T.DoubleType())))
    return small.unionByName(sums.groupBy("series_id").applyInArrow(united, schema))


def _linear(series: DataFrame, modes: DataFrame, most: int, b: Baseline) -> DataFrame:
    """modes with s_coeff, c_coeff and the fit's rss, all waves of a series at once."""
    beta = _mode_fits(series, modes, most, False, b)
    at = (F.col("mode") - 1) * 2
    return modes.drop("s_coeff", "c_coeff", "rss").join(beta, "series_id").withColumns({"s_coeff": F.get("beta", at), "c_coeff": F.get("beta", at + 1)}).drop("beta")


def _refined_whole(series: DataFrame, start: DataFrame, b: Baseline, rounds: int) -> DataFrame:
    """``start`` (series_id, mode, f, low, high) with f, s_coeff, c_coeff and rss after all rounds of ``global_refinement``: a series' points
    meet once in one task, which does its rounds."""
    packed = start.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("mode", "f", "low", "high"))).alias("m_"))
    part = lambda c: F.transform("m_", lambda m: m[c].cast("double")).alias(f"{c}_")
    packed = packed.select("series_id", *[part(c) for c in ("mode", "f", "low", "high")])
    rows = series.withColumn("u_", _night_slopes(series, b) if b.slopes else F.lit(0.0)).withColumn("w_", b.w)
    keys = ("series_id", *([b.night] if b.night else []))
    rows = rows.select(*keys, F.col("t").cast("double"), F.col("y").cast("double"), "u_", "w_").filter("t is not null and y is not null and w_ > 0").join(packed, "series_id")
    first = int(b.offsets) + int(b.slopes)

    def fitted(x: np.ndarray, points: np.ndarray, night: np.ndarray) -> tuple[np.ndarray, float]:
        """beta and rss beside the baseline of each night."""
        t, y, u, w = points
        x = np.column_stack([*([np.ones(len(t))] if b.offsets else []), *([u] if b.slopes else []), x, y])
        total = np.zeros((x.shape[1] - first,) * 2)
        for n in range(night.max() + 1):
            own = night == n
            m = (x[own] * w[own][:, None]).T @ x[own]
            for i in range(first):
                if m[i, i] > 0:
                    m = m - np.outer(m[i], m[i]) / m[i, i]
            total = total + m[first:, first:]
        beta = pseudo_solved(total[:-1, :-1], total[:-1, -1])
        return beta, max(float(total[-1, -1] - beta @ total[:-1, -1]), 0.0)

    def waves(t: np.ndarray, f: np.ndarray, coeff: np.ndarray | None = None) -> np.ndarray:
        angle = TAU * np.outer(t, f)
        sin, cos = np.sin(angle), np.cos(angle)
        parts = [sin, cos] if coeff is None else [sin, cos, TAU * t[:, None] * (coeff[0::2] * cos - coeff[1::2] * sin)]
        return np.stack(parts, 2).reshape(len(t), -1)

    def refined(points: np.ndarray, night: np.ndarray, f: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        t, damp = points[0], 1.0
        beta, rss = fitted(waves(t, f), points, night)
        for _ in range(rounds):
            step = fitted(waves(t, f, beta), points, night)[0][2::3]
            moved = f + step * damp
            moved = np.where(np.isnan(moved), high, np.minimum(np.maximum(moved, low), high))
            new, new_rss = fitted(waves(t, moved), points, night)
            if new_rss <= rss or np.isnan(rss):
                f, beta, rss, damp = moved, new, new_rss, min(damp * 2, 1.0)
            else:
                damp /= 4
        return f, beta, rss

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Series come one after another, maybe over several batches."""
        waiting, ready = [], []

        def told() -> list[pa.Array]:
            own = pa.Table.from_batches(waiting).combine_chunks()
            mode, f, low, high = (np.array(own.column(f"{c}_")[0].as_py(), float) for c in ("mode", "f", "low", "high"))
            points = np.stack([own.column(c).to_numpy() for c in ("t", "y", "u_", "w_")])
            night = pc.dictionary_encode(own.column(b.night).combine_chunks(), null_encoding="encode").indices.to_numpy() if b.night else np.zeros(len(points[0]), np.int64)
            f, beta, rss = refined(points, night, f, low, high)
            name = pa.array([own.column("series_id")[0].as_py()] * len(f), kind)
            return [name, pa.array(mode.astype(np.int32)), *[pa.array(x) for x in (f, low, high, np.full(len(f), rss), beta[0::2].copy(), beta[1::2].copy())]]

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*ready, strict=True)], schema.names)
            ready.clear()
            return out

        for batch in batches:
            of = pc.dictionary_encode(batch.column("series_id")).indices.to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
            for a, z in itertools.pairwise(starts):
                if z > a:
                    if waiting and waiting[0].column("series_id")[0] != batch.column("series_id")[a]:
                        ready.append(told())
                        waiting.clear()
                    waiting.append(batch.slice(a, z - a))
            if len(ready) > 1000:
                yield given()
        if waiting:
            ready.append(told())
        if ready:
            yield given()

    schema = T.StructType([rows.schema["series_id"]]).add("mode", T.IntegerType())
    for n in ("f", "low", "high", "rss", "s_coeff", "c_coeff"):
        schema = schema.add(n, "double")
    kind = to_arrow_type(rows.schema["series_id"].dataType)
    return by_series(rows).sortWithinPartitions(*keys).mapInArrow(each, schema)


def _numbered(modes: DataFrame) -> DataFrame:
    return modes.withColumn("mode", F.row_number().over(by().orderBy("f")).cast("int"))


def global_refinement(series: DataFrame, modes: DataFrame, spans: DataFrame, rounds: int = 12, baseline: Baseline | str | None = None, bound: float = 3.0, fmin: float = 0.01, fmax: float = 50.0) -> DataFrame:
    """All modes of a series at once, beside a baseline: seeds (series_id, f, in order of ``mode``) closer than
    ``SEPARATION`` / T to a better one go; frequencies move within ``bound`` / T by Gauss-Newton steps, of which the half, a
    quarter and so on are tried until the fit gets better; close modes collapse and the waves are fitted again.
    (series_id, mode, f, s_coeff, c_coeff, rss), modes numbered by frequency."""
    b = Baseline.of(baseline)
    reach = spans.select("series_id", F.greatest(bound / F.greatest("t_full", F.lit(1e-8)), F.lit(1e-8)).alias("reach"), F.greatest(SEPARATION / F.greatest("t_full", F.lit(1e-8)), F.lit(1e-8)).alias("sep"))
    seeds = spaced(modes.join(reach, "series_id").select("series_id", "mode", "f", "reach", "sep"), ["mode", "f"], F.col("sep"))
    limits = {"low": F.greatest(F.lit(fmin), F.col("f") - F.col("reach")), "high": F.least(F.lit(fmax), F.col("f") + F.col("reach"))}
    start = stored(_numbered(seeds.withColumns(limits)).select("series_id", "mode", "f", "low", "high"), "refined")
    most = start.agg(F.max("mode")).first()[0] or 0
    if not most:
        return start.select("series_id", "mode", "f", *[F.lit(None).cast("double").alias(c) for c in ("s_coeff", "c_coeff", "rss")])
    few = series.filter("t is not null and y is not null").groupBy("series_id").agg((F.count("*") * (3 * most + 4) <= 64 * WHOLE).alias("few_"))  # the columns of a fit with slopes
    few = stored(few.join(start.select("series_id").distinct(), "series_id"), "sizes")
    whole, long = (few.filter(c).select("series_id") for c in ("few_", "not few_"))
    done = stored(_refined_whole(series.join(whole, "series_id", "left_semi"), start.join(whole, "series_id", "left_semi"), b, rounds), "refined")
    every, start = series, start.join(long, "series_id", "left_semi")
    if long.isEmpty():
        rounds, best = 0, done
    else:
        series = series.join(long, "series_id", "left_semi")
        best = stored(_linear(series, start, most, b).withColumn("damp", F.lit(1.0)), "refined")
    for _ in range(rounds):
        beta = _mode_fits(series, best, most, True, b).select("series_id", "beta")
        step = F.coalesce(F.get("beta", (F.col("mode") - 1) * 3 + 2), F.lit(0.0)) * F.col("damp")
        moved = best.join(beta, "series_id").withColumn("f", F.least(F.greatest(F.col("f") + step, F.col("low")), F.col("high")))
        tried = _linear(series, moved.drop("beta"), most, b)
        new = tried.select("series_id", "mode", *[F.col(c).alias(f"new_{c}") for c in ("f", "s_coeff", "c_coeff", "rss")])
        better = F.col("new_rss") <= F.col("rss")
        both = best.join(new, ["series_id", "mode"])
        pick = lambda c: F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        former = best
        best = stored(both.select("series_id", "mode", pick("f"), "low", "high", pick("rss"), pick("s_coeff"), pick("c_coeff"), F.when(better, F.least(F.col("damp") * 2, F.lit(1.0))).otherwise(F.col("damp") / 4).alias("damp")), "refined")
        discard(former)
    amp = amplitude(F.col("s_coeff"), F.col("c_coeff"))
    both = best if rounds == 0 else best.drop("damp").unionByName(done)
    merged = collapsed(both.select("series_id", "mode", "f", amp.alias("amp")).join(reach, "series_id"), F.col("sep"))
    return stored(_linear(every, stored(_numbered(merged.select("series_id", "f")), "refined"), most, b).select("series_id", "mode", "f", "s_coeff", "c_coeff", "rss"), "refined")


def guided_rows(series: DataFrame, templates: DataFrame, spans: DataFrame, fmin: float = 0.2, fmax: float = 50.0, half_bins: float = 10.0, snr_min: float = 2.0, baseline: Baseline | str | None = None, steps: int = 1001, most: int = 1201, oversample: float = 2.0, side: float = GUIDED_SIDES) -> tuple[DataFrame, DataFrame]:
    """(search table, series without the modes found). Each template frequency (series_id, mode, f_template) in order: local
    spectrum, fit within it, test, prewhiten where it is detected. With ``resolution`` in ``templates``, that of the series they
    come from, the search reaches ``half_bins`` times the coarser of both and steps by the finer one over ``oversample``.
    Columns series_id, mode, f_template, detected, f, amp, phase, snr, w, skip_reason."""
    b, without, out, t = Baseline.of(baseline), series, None, _span("t_full")
    left = packed_samples(series, b)
    told = templates if "resolution" in templates.columns else templates.withColumn("resolution", F.lit(None).cast("double"))
    coarse, fine = F.greatest("resolution", 1.0 / t), F.least("resolution", 1.0 / t)
    for mode in range(1, (told.agg(F.max("mode")).first()[0] or 0) + 1):
        at = stored(told.filter(F.col("mode") == mode).join(spans, "series_id"), "templates")
        skipped = at.filter(F.col("f_template") < fmin)
        centres = at.filter(F.col("f_template") >= fmin).withColumnRenamed("f_template", "f0")
        grid = stored(local_grid(centres, half_bins * coarse, F.greatest(fine / oversample, F.lit(1e-8)), fmin, fmax, most).select("series_id", "j", "f"), "local-grid")
        spectrum = stored(nuisance_periodogram(left, grid, b).select("series_id", "j", "f", "power"), "local")
        peak = strongest(spectrum.filter("power is not null")).select("series_id", F.col("f").alias("f0")).join(spans, "series_id")
        edges = grid.groupBy("series_id").agg(F.min("f").alias("low"), F.max("f").alias("high"))
        fits = stored(frequency_fit(left, peak.join(edges, "series_id"), KFIT * 2.0 / t, fmin, fmax, steps, b, ("low", "high")), "fits")
        place = fits.select("series_id", F.col("f").alias("f0")).join(spans, "series_id").join(_bins(grid), "series_id")
        noise = snr_at(spectrum, place, KFIT * (2.0 / t), F.greatest(side * (1.0 / t), GUIDED_SIDE_BINS * F.col("bin_")))
        tested = centres.select("series_id", "mode", F.col("f0").alias("f_template")).join(fits, "series_id", "left").join(noise, "series_id", "left")
        ok = F.coalesce(F.col("snr") >= snr_min, F.lit(False))
        amp, phi = amplitude(F.col("s_coeff"), F.col("c_coeff")), phase(F.col("s_coeff"), F.col("c_coeff"))
        only = lambda c: F.when(F.col("detected"), c)
        why = F.when(F.col("f").isNull(), "no_finite_power").when(~F.col("detected"), "snr_below_threshold")
        found = tested.withColumn("detected", ok).withColumn("skip_reason", why)
        rows = stored(found.select("series_id", "mode", "f_template", "detected", only(F.col("f")).alias("f"), only(amp).alias("amp"), only(phi).alias("phase"), "snr", "w", "skip_reason", "s_coeff", "c_coeff"), "guided-rows")
        former, fitted = left, rows.filter("detected")
        left, without = left.less(fitted), prewhitened(without, fitted, baseline=b)
        former.discard()
        for done in (spectrum, fits, grid):
            discard(done)
        rows = rows.drop("s_coeff", "c_coeff").unionByName(skipped.select("series_id", "mode", "f_template", F.lit(False).alias("detected"), F.lit("below_minimum_frequency").alias("skip_reason")), allowMissingColumns=True)
        out = rows if out is None else out.unionByName(rows)
    return (out if out is None else stored(out, "guided-result")), without


def guided_search(series: DataFrame, templates: DataFrame, spans: DataFrame, baseline: Baseline | str | None = None, **options: object) -> DataFrame:
    """The whole search: ``guided_rows``; of detections within ``SEPARATION`` resolution elements (of the coarser series) the best
    stay; all are refined together on the series as it came; each takes the closest refined mode that is left. (series_id, mode,
    f_template, f_local, amp_local, phase_local, snr, w, f, amp, phase, s_coeff, c_coeff) of accepted templates."""
    rows, _ = guided_rows(series, templates, spans, baseline=baseline, **options)
    if rows is None:
        rows = templates.select("series_id", "mode", "f_template", F.lit(False).alias("detected"), *[F.lit(None).cast("double").alias(c) for c in ("f", "amp", "phase", "snr", "w")])
    coarse = templates.groupBy("series_id").agg((F.max("resolution") if "resolution" in templates.columns else F.lit(None).cast("double")).alias("r_"))
    sep = spans.join(coarse, "series_id").select("series_id", F.greatest(SEPARATION / _span("t_full"), SEPARATION * F.col("r_"), F.lit(1e-8)).alias("sep"))
    accepted = stored(deduped(rows.filter("detected").join(sep, "series_id"), F.col("sep")).drop("sep"), "accepted")
    score = F.row_number().over(by().orderBy(F.desc("snr"), "f")).alias("rank")
    refined = global_refinement(series, accepted.select("series_id", F.col("f"), score).withColumnRenamed("rank", "mode"), spans, baseline=baseline)
    amp, phi = amplitude(F.col("s_coeff"), F.col("c_coeff")), phase(F.col("s_coeff"), F.col("c_coeff"))
    pairs = matched(accepted.select("series_id", "mode", "f"), refined.select("series_id", "f", amp.alias("amp"), phi.alias("phase")))
    own = accepted.select("series_id", "mode", "f_template", F.col("f").alias("f_local"), F.col("amp").alias("amp_local"), F.col("phase").alias("phase_local"), "snr", "w")
    out = own.join(pairs.select("series_id", "mode", "f", "amp", "phase"), ["series_id", "mode"])
    return out.withColumns({"s_coeff": F.col("amp") * F.cos("phase"), "c_coeff": F.col("amp") * F.sin("phase")})


def photometric_modes(series: DataFrame, fmin: float, fmax: float, weight: str | None = None, **options: object) -> DataFrame:
    """All modes of photometric series: found one after another, near-duplicates merged, refined together, each with its refined
    mode. (series_id, mode, f_local, amp_local, phase_local, snr, w, f, amp, phase, resolution)."""
    found = sequential_modes(series, fmin, fmax, weight=weight, **options)
    spans = stored(longest_chunk(series), "spans")
    sep = spans.select("series_id", F.greatest(SEPARATION / _span("t_full"), F.lit(1e-8)).alias("sep"))
    local = stored(deduped(found.join(sep, "series_id"), F.col("sep")).drop("sep"), "local-modes")
    refined = global_refinement(series, local.select("series_id", "mode", "f"), spans, baseline=Baseline(weight=weight), fmin=fmin, fmax=fmax)
    amp, phi = amplitude(F.col("s_coeff"), F.col("c_coeff")), phase(F.col("s_coeff"), F.col("c_coeff"))
    pairs = matched(local.select("series_id", "mode", "f"), refined.select("series_id", "f", amp.alias("amp"), phi.alias("phase")))
    own = local.select("series_id", "mode", F.col("f").alias("f_local"), F.col("amp").alias("amp_local"), F.col("phase").alias("phase_local"), "snr", "w")
    res = spans.select("series_id", (1.0 / _span("t_full")).alias("resolution"))
    return own.join(pairs.select("series_id", "mode", "f", "amp", "phase"), ["series_id", "mode"]).join(res, "series_id")


def guided_channels(channels: DataFrame, photometric: DataFrame, baseline: Baseline | str | None = None, **options: object) -> DataFrame:
    """The guided search of all channels (target, channel, t, y, k and what the baseline needs) of all targets at once, by their
    photometric modes (``photometric_modes``; series_id is the target, unrefined modes stay local): target, channel and the
    columns of ``guided_search``."""
    keyed = channels.withColumn("series_id", F.concat_ws("|", F.col("target").cast("string"), F.col("channel").cast("string")))
    names = stored(keyed.select("series_id", "target", "channel").distinct(), "channels")
    series = stored(keyed.select("series_id", "t", "y", "k", *Baseline.of(baseline).columns), "channels")
    wanted = photometric.select(F.col("series_id").alias("target"), "mode", F.coalesce("f", "f_local").alias("f_template"), "resolution")
    templates = stored(names.join(wanted, "target").select("series_id", "mode", "f_template", "resolution"), "templates")
    found = guided_search(series, templates, stored(longest_chunk(series), "spans"), baseline, **options)
    return names.join(found, "series_id").drop("series_id")


def isolated(series: DataFrame, run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """(what ``run`` gives for all series, failures: series_id, reason). Series are run together; should that fail, each half of them
    (by a hash of their names) on its own, and so on, so a series that cannot be run stops no other, whatever the reason. Results
    are stored as they come; only how many series a part has, and the name of one that failed, reach the driver."""
    spark = series.sparkSession
    kind = series.schema["series_id"].dataType.simpleString()
    done, failed, parts = None, [], [(0, 0)]
    hashed = F.xxhash64(F.coalesce(F.col("series_id").cast("string"), F.lit("")))
    while parts:
        depth, number = parts.pop()
        own = series.filter(F.pmod(hashed, F.lit(1 << depth)) == number) if depth else series
        try:
            out = stored(run(own), "isolated")
        except Exception as error:  # any failure of a part is told apart by its halves
            names = own.select("series_id").distinct().limit(2).collect()
            if len(names) > 1 and depth < 40:
                parts += [(depth + 1, number), (depth + 1, number + (1 << depth))]
            else:
                failed += [(r.series_id, f"{type(error).__name__}: {str(error).strip().splitlines()[0][:300]}") for r in names]
            continue
        done = out if done is None else done.unionByName(out)
    return done, spark.createDataFrame(failed, f"series_id {kind}, reason string")


def batch_search(series: DataFrame, templates: DataFrame, least: int = 60, baseline: Baseline | str | None = None, **options: object) -> DataFrame:
    """The whole guided search (``guided_search``: search, duplicates, refinement, matching) for all series at once: series_id, n,
    status, reason, detected, best_snr, best_f. status is no_values, too_short (fewer than ``least`` good points), no_span, ok or
    failed (with its reason); points without finite t and y are left out. A series that cannot be searched leaves the others
    alone (``isolated``)."""
    good = stored(clean(series), "batch-good")
    counts = series.groupBy("series_id").agg(F.count("*").alias("rows_")).join(good.groupBy("series_id").agg(F.count("*").alias("n")), "series_id", "left")
    spans = longest_chunk(good)
    named = counts.join(spans, "series_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "no_values").when(F.col("n") < least, "too_short").when(F.col("t_full") <= 0, "no_span").otherwise("ok")
    named = stored(named.withColumn("status", status), "batch-spans")
    able = stored(named.filter("status = 'ok'").select("series_id", "t_full", "t_chunk"), "batch-able")

    def search(part: DataFrame) -> DataFrame:
        here = part.select("series_id").distinct()
        own = [x.join(here, "series_id", "left_semi") for x in (templates, able)]
        return guided_search(part, *own, baseline, **options)

    found, failed = isolated(good.join(able.select("series_id"), "series_id", "left_semi"), search)
    out = named.join(failed, "series_id", "left").withColumn("status", F.when(F.col("reason").isNotNull(), "failed").otherwise(F.col("status")))
    if found is None:
        return out.select("series_id", "n", "status", "reason", F.lit(0).cast("long").alias("detected"), *[F.lit(None).cast("double").alias(c) for c in ("best_snr", "best_f")])
    best = found.groupBy("series_id").agg(F.count("*").alias("detected"), F.max("snr").alias("best_snr"), F.max_by(F.coalesce("f", "f_local"), F.struct("snr", -F.col("f_local"))).alias("best_f"))
    return out.join(best, "series_id", "left").select("series_id", "n", "status", "reason", F.coalesce("detected", F.lit(0)).cast("long").alias("detected"), "best_snr", "best_f")


def harmonic_features(series: DataFrame, harmonics: int, f: str = "f") -> tuple[DataFrame, list[str]]:
    out, names = series.withColumn("one", F.lit(1.0)), ["one"]
    for h in range(1, harmonics + 1):
        angle = TAU * h * F.col(f) * F.col("t")
        out = out.withColumns({f"s{h}": F.sin(angle), f"c{h}": F.cos(angle)})
        names += [f"s{h}", f"c{h}"]
    return out, names


def multiharmonic_power(series: DataFrame | Samples, grid: DataFrame, harmonics: int = 5) -> DataFrame:
    """Share of the variance that an offset and ``harmonics`` sinusoids remove, for each frequency of an even grid."""
    return harmonic_power(series, grid, harmonics)


def harmonic_snr(spectrum: DataFrame, at: DataFrame, share: float = 0.02, guard: int = 5) -> DataFrame:
    """(series_id, snr): (peak - median) / MAD within +-share of the span outside ``guard`` bins; null where fewer than 20
    bins are near or fewer than 10 are left."""
    peak = at.select("series_id", F.col("j").alias("j0"), F.col("f").alias("f0"), F.col("power").alias("peak_"))
    span = spectrum.withColumn("span_", F.max("f").over(by()) - F.min("f").over(by())).join(peak, "series_id")
    near = span.filter(F.abs(F.col("f") - F.col("f0")) <= share * F.col("span_")).withColumn("near_", F.count("*").over(by()))
    kept = near.filter(F.abs(F.col("j") - F.col("j0")) > guard).withColumn("m_", F.median("power").over(by()))
    mad = F.nullif(F.median(F.abs(F.col("power") - F.col("m_"))), F.lit(0.0))
    enough = (F.max("near_") >= 20) & (F.count("*") >= 10)
    return kept.groupBy("series_id").agg(F.when(enough, (F.max("peak_") - F.max("m_")) / mad).alias("snr"))


def harmonic_prewhitened(series: DataFrame, grid: DataFrame, rounds: int = 3, harmonics: int = 5, stop: float = 3.0, reach: float = 0.05, steps: int = 201) -> DataFrame:
    """series with ``y`` free of up to ``rounds`` periodic signals of ``harmonics`` terms. A signal's frequency is the one of least
    residual within ``reach`` of the peak's and inside the grid: ``steps`` even points over that range, and as many again over
    two steps around the best, twice."""
    left, done = packed_samples(series), []
    ends = stored(grid.groupBy("series_id").agg(F.min("f").alias("first_"), F.max("f").alias("last_")), "ends")
    for _ in range(rounds):
        spectrum = stored(multiharmonic_power(left, grid, harmonics), "spectrum")
        best = strongest(spectrum)
        go = stored(best.join(harmonic_snr(spectrum, best), "series_id").filter(F.col("snr") >= stop).select("series_id", "f"), "harmonic-at")
        if go.isEmpty():
            break
        low, high = F.greatest("first_", F.col("f") * (1 - reach)), F.least("last_", F.col("f") * (1 + reach))
        window = go.join(ends, "series_id").select("series_id", F.col("f").alias("at_"), low.alias("low_"), high.alias("high_"))
        for n in range(3):
            fine = window.select("series_id", F.lit(0).cast("long").alias("j0_"), "low_", "high_", F.lit(steps).cast("long").alias("n_"))
            if n == 2:
                fits = stored(harmonic_fit(left, fine, harmonics), "harmonic-fit")
                break
            finest = harmonic_power(left, fine, harmonics, best=True).select("series_id", "f").join(window, "series_id")
            step = (F.col("high_") - F.col("low_")) / (steps - 1)
            window = stored(finest.select("series_id", F.col("f").alias("at_"), F.greatest("low_", F.col("f") - step).alias("low_"), F.least("high_", F.col("f") + step).alias("high_")), "harmonic-window")
        done.append(fits.withColumn("round_", F.lit(len(done))))
        former, left = left, left.less_harmonics(fits)
        former.discard()
        discard(spectrum)
    return _without_harmonics(series, functools.reduce(DataFrame.unionByName, done)) if done else series


def _without_harmonics(series: DataFrame, fits: DataFrame) -> DataFrame:
    """``series`` less the fits of all rounds (series_id, f, beta, round_), one after another, in one pass; other columns go along."""
    waves = fits.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("round_", "f", "beta"))).alias("waves_"))
    rows = series.withColumn("y", F.col("y").cast("double"))
    names = rows.columns

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, y = (pc.fill_null(pc.cast(batch.column(c), pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in ("t", "y"))
            y, none = y.copy(), pc.is_null(batch.column("y")).to_numpy(zero_copy_only=False)
            for _, at in _groups(batch, ("series_id",)):
                for w in batch.column("waves_")[int(at[0])].as_py() or []:
                    y[at] -= harmonic_wave(t[at], w["f"], w["beta"])
                    none[at] |= np.isnan(t[at])
            yield pa.RecordBatch.from_arrays([pa.array(y, mask=none) if n == "y" else batch.column(n) for n in names], names)

    return rows.join(F.broadcast(waves), "series_id", "left").select(*names, "waves_").mapInArrow(rest, rows.schema)


def _both_whitened(first: DataFrame | Samples, second: DataFrame | Samples, grid: DataFrame, spans: DataFrame, weights: DataFrame, one: Baseline, two: Baseline) -> DataFrame:
    """(series_id, j, f, power, white, white2, score) on a grid: both series' whitened spectra (noise windows by t_full and t2) and
    their mean by ``weights`` (series_id, w1, w2)."""
    a = whitened(stored(lomb_scargle(first, grid, one.w), "spec"), spans.select("series_id", "t_full"), ks=SIDES).select("series_id", "j", "f", "power", "white")
    night = stored(nuisance_periodogram(second, grid, two).select("series_id", "j", "f", "power"), "spec")
    b = whitened(night, spans.select("series_id", "t2"), "t2", ks=NIGHT_SIDES)
    both = a.join(b.select("series_id", "j", F.col("white").alias("white2")), ["series_id", "j"]).join(weights, "series_id")
    return both.withColumn("score", combined_power(F.col("white"), F.col("white2"), F.col("w1"), F.col("w2"))).drop("w1", "w2")


def fine_peaks(series: DataFrame | Samples, other: DataFrame | Samples, peaks: DataFrame, spans: DataFrame, weights: DataFrame, fmin: float, fmax: float, one: Baseline, two: Baseline) -> DataFrame:
    """(series_id, f0, f, score, white, white2): of each peak (series_id, f0, sep) the largest combined whitened power on a grid
    of sep / 10 within 3 sep; all peaks of all series in one plan."""
    key = F.concat_ws("|", F.col("f0").cast("string"), F.col("series_id").cast("string"))
    keyed = stored(peaks.select("series_id", "f0", "sep", key.alias("key_")), "fine-peaks")
    reach = 3 * F.col("sep")
    size = F.floor((F.least(F.lit(fmax), F.col("f0") + reach) - F.greatest(F.lit(fmin), F.col("f0") - reach)) / (F.col("sep") / 10)) + 1
    points = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(size, F.lit(1)).cast("long") - 1))
    grid = keyed.select(F.col("key_").alias("series_id"), "f0", "sep", points.alias("j"))
    grid = stored(grid.select("series_id", "j", (F.greatest(F.lit(fmin), F.col("f0") - reach) + F.col("j") * (F.col("sep") / 10)).alias("f")), "fine")
    own = lambda s: s.join(keyed.select("series_id", "key_"), "series_id").drop("series_id").withColumnRenamed("key_", "series_id")
    points = lambda s: s.renamed(keyed.select("series_id", "key_")) if isinstance(s, Samples) else own(s)
    both = _both_whitened(points(series), points(other), grid, own(spans), own(weights), one, two)
    best = F.max_by(F.struct("f", "score", "white", "white2"), F.struct("score", -F.col("j"))).alias("b")
    return both.filter("score is not null").groupBy(F.col("series_id").alias("key_")).agg(best).join(keyed.select("key_", "series_id", "f0"), "key_").select("series_id", "f0", "b.*")


def _spans_of_both(first: DataFrame, second: DataFrame) -> DataFrame:
    other = longest_chunk(second).select("series_id", F.col("t_full").alias("t2"), F.col("t_chunk").alias("t2_chunk"))
    return longest_chunk(first).join(other, "series_id")


def refined_peak(series: DataFrame, other: DataFrame, peaks: DataFrame, df: Column, fmin: float, fmax: float) -> DataFrame:
    """(series_id, f, score): the largest combined whitened power on a grid of df / 10 within 3 df of f0."""
    spans = stored(_spans_of_both(series, other), "spans")
    weights = spans.select("series_id", F.lit(1.0).alias("w1"), F.lit(1.0).alias("w2"))
    fine = fine_peaks(series, other, peaks.withColumn("sep", df), spans, weights, fmin, fmax, Baseline(), Baseline())
    return fine.select("series_id", "f", "score")


def joint_modes(first: DataFrame, second: DataFrame, fmin: float, fmax: float, baseline: Baseline | str | None = None, rounds: int = 20, snr_stop: float = 2.0, prefilter: float = 1.5, most: int = 60_000, steps: int = 2001, kfit: float = KFIT, prominence: float = 1.0, weight: str | None = None, mode: str = "equal", given: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Modes that two series of one target share, the second with a ``baseline`` (nights, weights), the first with ``weight``. A
    round: the 10 highest peaks of the combined whitened spectrum (data sets weighted by ``mode``: see ``dataset_weight``) and the 3
    highest of the first series', merged, refined on fine grids, the best whose two whitened powers pass ``prefilter``; fits
    with errors and tests on local spectra of both series; stop where both are weak; prewhiten both."""
    one, two = Baseline(weight=weight), Baseline.of(baseline)
    spans = stored(_spans_of_both(first, second), "spans")
    longest = _span(F.greatest("t_chunk", "t2_chunk"))
    weights = stored(spans.select("series_id", dataset_weight(mode, F.col("t_chunk"), given[0]).alias("w1"), dataset_weight(mode, F.col("t2_chunk"), given[1]).alias("w2")), "weights")
    sep = stored(spans.select("series_id", (1.0 / longest).alias("sep")), "separation")
    grid = stored(frequency_grid(spans.select("series_id", longest.alias("longest")), fmin, fmax, span="longest", most=most), "grid")
    groups = second.groupBy("series_id").agg(F.count_distinct(two.night).cast("int").alias("n_groups")) if two.night else spans.select("series_id", F.lit(0).alias("n_groups"))
    groups = stored(groups, "groups")
    a, b, out = stored(first, "joint"), stored(second, "joint"), None
    for n in range(1, rounds + 1):
        both = stored(_both_whitened(a, b, grid, spans, weights, one, two), "both")
        peaks = [top_peaks(both, k, F.col("sep"), prominence, v, sep).select("series_id", "f", F.col(v).alias("height"), "sep") for v, k in (("score", 10), ("power", 3))]
        candidates = merged_peaks(peaks, F.col("sep")).select("series_id", F.col("f").alias("f0"))
        fine = fine_peaks(a, b, candidates.join(sep, "series_id"), spans, weights, fmin, fmax, one, two)
        good = fine.filter((F.col("white") > prefilter) & (F.col("white2") > prefilter))
        best = F.max_by(F.struct(F.col("f").alias("f0"), "score", "white", "white2"), F.struct("score", -F.col("f")))
        at = stored(good.groupBy("series_id").agg(best.alias("b")).select("series_id", "b.*").join(spans, "series_id"), "joint-at")
        if at.isEmpty():
            break
        fa = stored(with_errors(frequency_fit(a, at, kfit * 2.0 / F.col("t_full"), fmin, fmax, steps, one)), "fit")
        fb = stored(with_errors(frequency_fit(b, at, kfit * 2.0 / F.col("t2"), fmin, fmax, steps, two)), "fit")
        named = lambda fit, snr, tag: fit.join(snr, "series_id", "left").select("series_id", *[F.col(c).alias(f"{c}_{tag}") for c in ("f", "amp", "amp_err", "phase", "phase_err", "snr", "w")])
        first_part = named(fa, snr_after_fit(a, fa, spans, fmin, fmax, baseline=one), "first")
        second_part = named(fb, snr_after_fit(b, fb, spans, fmin, fmax, "t2", True, baseline=two), "second")
        rows = at.select("series_id", F.lit(n).alias("n"), F.col("f0").alias("f_comb"), F.col("score").alias("score_comb"), F.col("white").alias("w_first_at_pick"), F.col("white2").alias("w_second_at_pick"))
        rows = rows.join(first_part, "series_id").join(second_part, "series_id").join(groups, "series_id", "left")
        rows = rows.withColumns({"offsets": F.lit(bool(two.night and two.offsets)), "slopes": F.lit(bool(two.night and two.slopes))})
        weak = F.coalesce((F.col("snr_first") < snr_stop) & (F.col("snr_second") < snr_stop), F.lit(False))
        rows = stored(rows.filter(~weak), "joint-rows")
        if rows.isEmpty():
            break
        out = rows if out is None else stored(out.unionByName(rows), "joint-all")
        go, former = rows.select("series_id"), (a, b, both)
        a = stored(prewhitened(a.join(go, "series_id", "left_semi"), fa, baseline=one), "joint")
        b = stored(prewhitened(b.join(go, "series_id", "left_semi"), fb, baseline=two), "joint")
        for done in former:
            discard(done)
    if out is None:
        double = [f"{c}_{tag}" for tag in ("first", "second") for c in ("f", "amp", "amp_err", "phase", "phase_err", "snr", "w")]
        kinds = {"n": "int", "n_groups": "int", "offsets": "boolean", "slopes": "boolean"}
        names = ["n", "f_comb", "score_comb", "w_first_at_pick", "w_second_at_pick", *double, "n_groups", "offsets", "slopes"]
        out = spans.limit(0).select("series_id", *[F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in names])
    return out


def with_periods(modes: DataFrame, *frequencies: str) -> DataFrame:
    """A period column right after each frequency column."""
    names = []
    for c in modes.columns:
        names.append(F.col(c))
        if c in frequencies:
            names.append(period(F.col(c)).alias(c.replace("f_", "period_", 1) if c.startswith("f_") else f"{c}_period"))
    return modes.select(*names)


def joint_summary(modes: DataFrame, channels: tuple, min_sep: float | Column, snr_min: float = 2.0) -> DataFrame:
    """One row a mode and target of joint modes of all channels (series_id: the target, channel, the columns f, amp, amp_err, phase,
    phase_err, snr of the first series and f2, amp2, amp_err2, phase2, phase_err2, snr2 of the second): greedy by (snr, amp),
    numbered by frequency, each with every channel's nearest mode (higher snr2 among equals): six columns a channel.
    ``min_sep`` may be a column of ``modes`` that is one value a target."""
    sep = {"sep_of": min_sep} if isinstance(min_sep, Column) else {"sep_of": F.lit(float(min_sep))}
    strong = modes.withColumns(sep).filter(F.col("snr") >= snr_min).select("series_id", "f", "amp", "amp_err", "phase", "phase_err", "snr", "sep_of")
    kept = spaced(strong, [F.desc("snr"), F.desc("amp"), "f"], F.col("sep_of")).drop("sep_of")
    kept = stored(kept.withColumn("mode", F.row_number().over(by().orderBy("f"))), "summary")
    out = kept.select("series_id", "mode", "f", period(F.col("f")).alias("period"), (1000 * F.col("amp")).alias("amp_ppt"), (1000 * F.col("amp_err")).alias("amp_err_ppt"), "phase", "phase_err")
    own = modes.filter(F.col("channel").isin(*channels)).select("series_id", "channel", F.col("f").alias("f_"), "f2", "amp2", "amp_err2", "phase2", "phase_err2", "snr2")
    near = F.min_by(F.struct("f2", "amp2", "amp_err2", "phase2", "phase_err2"), F.struct(F.abs(F.col("f_") - F.col("f")), -F.coalesce("snr2", F.lit(-1.0))))
    best = kept.select("series_id", "mode", "f").join(own, "series_id").groupBy("series_id", "mode").pivot("channel", list(channels)).agg(near)
    told = []
    for ch in channels:
        b = F.col(f"`{ch}`")
        told += [b["f2"].alias(f"{ch}_f"), period(b["f2"]).alias(f"{ch}_period"), b["amp2"].alias(f"{ch}_amp"), b["amp_err2"].alias(f"{ch}_amp_err"), b["phase2"].alias(f"{ch}_phase"), b["phase_err2"].alias(f"{ch}_phase_err")]
    return out.join(best.select("series_id", "mode", *told), ["series_id", "mode"], "left")


def isolated_modes(residual: DataFrame, modes: DataFrame, top: int, t0: float = 0.0) -> DataFrame:
    """For the ``top`` largest modes of a series: folded phase and the final residual with that mode put back."""
    rank = F.row_number().over(by().orderBy(F.desc("amp"), "f"))
    best = modes.withColumn("rank", rank).filter(F.col("rank") <= top).select("series_id", "rank", "f", "s_coeff", "c_coeff")
    rows = residual.join(best, "series_id")
    wave = sinusoid(F.col("t"), F.col("f"), F.col("s_coeff"), F.col("c_coeff"))
    return rows.select("series_id", "rank", "f", "t", "k", F.pmod((F.col("t") - t0) * F.col("f"), F.lit(1.0)).alias("phase"), (F.col("y") + wave).alias("signal"))
