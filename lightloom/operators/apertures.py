"""Aperture growth: inherently sequential, one small group (a stamp's cube) at a time, many stamps in parallel.

Spark prepares cubes, images, seeds and regions and sums the light curves; the helpers below only choose pixels.
Ties go to the lowest (row, column).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.waves import in_circle
from ..tables import stored
from .pixels import NEIGHBOURS, aperture_sums, extraction_mode, mean_image, nearest_seed, peak_seeds, region_threshold, smoothed
from .series import gap_segments, level

MASK = "stamp_id {kind}, target int, row int, col int, step int"


def _noise(curve: np.ndarray) -> float:
    """Standard deviation of first differences of the curve over its median; never negative."""
    m = np.median(curve)
    return float(np.std(np.diff(curve)) / abs(m)) if len(curve) >= 10 and np.isfinite(m) and m != 0 else np.inf


def _swing(curve: np.ndarray) -> float:
    m = np.median(curve)
    rel = curve / m if m != 0 else curve
    return float(np.subtract(*np.percentile(rel, [99, 1]))) if len(curve) >= 10 else np.nan


def _around(pixels: list[tuple], allowed: set[tuple]) -> list[tuple]:
    taken = set(pixels)
    return sorted({(r + i, c + j) for r, c in pixels for i, j in NEIGHBOURS} & allowed - taken)


def _grow(curves: dict[tuple, np.ndarray], start: list[tuple], allowed: set[tuple], least: int, swing_share: float = 0.01) -> list[tuple]:
    """Add the neighbour that leaves the least noise while noise falls (or the aperture is small)."""
    reference = _swing(sum(curves[p] for p in allowed))
    floor = swing_share * reference if np.isfinite(reference) else -np.inf
    chosen, curve = list(start), sum(curves[p] for p in start)
    noise = _noise(curve)
    while True:
        trials = []
        for p in _around(chosen, allowed):
            trial = curve + curves[p]
            if np.median(trial) != 0 and _swing(trial) >= floor:
                trials.append((_noise(trial), p))
        if not trials or min(trials)[0] == np.inf:
            return chosen
        best, p = min(trials)
        if best >= noise and len(chosen) >= least:
            return chosen
        chosen.append(p)
        curve, noise = curve + curves[p], best


def _components(curves: dict, image: dict, seed: tuple, allowed: set[tuple], least: int, most: int = 3, share: float = 0.15) -> list[tuple]:
    """Growth again from the brightest pixel that is left, while it has ``share`` of the region's peak."""
    peak, out, free, at = max(image[p] for p in allowed), [], set(allowed), seed
    for k in range(most):
        if not free or (k and image[at] < share * peak):
            break
        out += _grow(curves, [at], free, least)
        free = allowed - set(out)
        at = max(sorted(free), key=lambda p: image[p], default=None)
    return out


def _core(image: dict, seed: tuple, allowed: set[tuple], size: int = 12, share: float = 0.25) -> list[tuple]:
    """The seed's brightest connected pixels above ``share`` of the peak."""
    peak = max(image[p] for p in allowed)
    bright = {p for p in allowed if image[p] >= share * peak} | {seed}
    out = [seed]
    while len(out) < size and (near := _around(out, bright)):
        out.append(max(near, key=lambda p: (image[p], -p[0], -p[1])))
    return out


def _path(image: dict, seed: tuple, allowed: set[tuple], most: int = 45, share: float = 0.05) -> list[tuple]:
    """The brightest 4-neighbour of the pixel added last, until it is fainter than ``share`` of the seed."""
    out, at = [seed], seed
    while len(out) < most:
        near = [p for p in ((at[0] - 1, at[1]), (at[0] + 1, at[1]), (at[0], at[1] - 1), (at[0], at[1] + 1)) if p in allowed and p not in out]
        best = max(sorted(near), key=lambda p: image[p], default=None)
        if best is None or image[best] < share * image[seed]:
            break
        out.append(best)
        at = best
    return out


def _old_frame(row: int, col: int, nrow: int, ncol: int) -> bool:
    """Where the older geometry rule lets a pixel join, by its number from 1 along the rows."""
    k = row * ncol + col + 1
    return k % nrow > 1 and k % ncol < 20 and k != 19


def _exhaustive(curves: dict, image: dict, threshold: float = 3000.0, joins: Callable[[tuple], bool] = lambda p: True) -> tuple[list[tuple], int, float]:
    """From the pixels over the threshold (else the brightest) add, one after another, the pixel with the least sum of absolute
    steps per flux; the prefix with the least noise per mean flux is the aperture. Candidates are positive on average, are let in
    by ``joins`` and are not the stamp's first pixel. (aperture, pixels at first, merit)."""
    pixels = sorted(image)
    chosen = [p for p in pixels if image[p] > threshold] or [max(pixels, key=lambda p: (image[p], -p[0], -p[1]))]
    curve, first = sum(curves[p] for p in chosen), len(chosen)
    merit = lambda x: np.std(np.diff(x)) / x.mean() if x.mean() != 0 else np.inf
    merits, rest = [merit(curve)], [p for p in pixels if p not in chosen and image[p] > 0 and p != (0, 0) and joins(p)]
    while rest:
        steps = [np.abs(np.diff(curve + curves[p])).sum() / (curve + curves[p]).sum() if (curve + curves[p]).sum() else np.inf for p in rest]
        k = int(np.argmin(steps))
        if not np.isfinite(steps[k]):
            break
        curve = curve + curves[rest[k]]
        chosen.append(rest.pop(k))
        merits.append(merit(curve))
    best = int(np.argmin(merits))
    return chosen[: first + best], first, float(merits[best])


def exhaustive_aperture(pixels: DataFrame, threshold: float = 3000.0, nback: int = 20, legacy: bool = True) -> tuple[DataFrame, DataFrame]:
    """The exhaustive aperture of whole stamps, with or without the older geometry rule: (stamp_id, target, row, col, step), and a
    row of figures a stamp: nrow, ncol, npix, n_cadences_used, n_initial_pixels, n_pixels_in_best_curve, best_fom, threshold,
    nback, legacy_geometry. Frames begin at row and column 0; a stamp of fewer than 3 cadences has neither."""
    curves = F.transform(F.sort_array(F.collect_list(F.struct("cadence", "flux"))), lambda x: x["flux"]).alias("curve")
    cubes = pixels.groupBy("stamp_id", "row", "col").agg(curves)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {(r, c): np.nan_to_num(np.asarray(x, float)) for r, c, x in zip(pdf["row"], pdf["col"], pdf["curve"], strict=True)}
        nrow, ncol, n = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1, len(next(iter(own.values())))
        if n < 3:
            return pd.DataFrame(columns=names)
        image = {p: float(x.mean()) for p, x in own.items()}
        chosen, first, fom = _exhaustive(own, image, threshold, (lambda p: _old_frame(*p, nrow, ncol)) if legacy else (lambda p: True))
        figures = {"nrow": nrow, "ncol": ncol, "npix": nrow * ncol, "n_cadences_used": n, "n_initial_pixels": first, "n_pixels_in_best_curve": len(chosen), "best_fom": fom, "threshold": threshold, "nback": min(nback, nrow * ncol), "legacy_geometry": legacy}
        return pd.DataFrame({"stamp_id": pdf["stamp_id"].iat[0], "target": 0, "row": [p[0] for p in chosen], "col": [p[1] for p in chosen], "step": range(len(chosen)), **figures})

    figures = "nrow int, ncol int, npix int, n_cadences_used int, n_initial_pixels int, n_pixels_in_best_curve int, best_fom double, threshold double, nback int, legacy_geometry boolean"
    kind = pixels.schema["stamp_id"].dataType.simpleString()
    names = [f.split()[0] for f in f"{MASK}, {figures}".split(", ")]
    out = stored(cubes.groupBy("stamp_id").applyInPandas(run, f"{MASK.format(kind=kind)}, {figures}"), "exhaustive")
    return out.select(*names[:5]), out.filter("step = 0").select("stamp_id", *names[5:])


def _flood(image: dict, seeds: list[tuple], mask: set[tuple]) -> dict[tuple, int]:
    """Watershed of the negative image from markers: the brightest waiting pixel next, first come among equals."""
    import heapq

    owner, heap, age = {}, [], 0
    for k, s in enumerate(seeds):
        heapq.heappush(heap, (-image[s], age, s, k))
        owner[s] = k
        age += 1
    while heap:
        _, _, p, k = heapq.heappop(heap)
        for q in ((p[0] - 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] + 1, p[1])):
            if q in mask and q not in owner:
                owner[q] = k
                age += 1
                heapq.heappush(heap, (-image[q], age, q, k))
    return owner


def _grouped(pixels: DataFrame, regions: DataFrame, seeds: DataFrame, choose: Callable) -> DataFrame:
    """Run ``choose(curves, image, seed, allowed)`` for every (stamp, target): mask rows in the order of growth."""
    cubes = pixels.groupBy("stamp_id", "row", "col").agg(F.transform(F.sort_array(F.collect_list(F.struct("cadence", "flux"))), lambda x: x["flux"]).alias("curve"))
    owned = cubes.join(regions, ["stamp_id", "row", "col"]).join(seeds.select("stamp_id", F.col("target").alias("owner"), F.col("row").alias("seed_row"), F.col("col").alias("seed_col")), ["stamp_id", "owner"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        curves = {(r, c): np.nan_to_num(np.asarray(x, float)) for r, c, x in zip(pdf["row"], pdf["col"], pdf["curve"], strict=True)}
        image = {p: float(x.mean()) for p, x in curves.items()}
        seed = (pdf["seed_row"].iat[0], pdf["seed_col"].iat[0])
        chosen = choose(curves, image, seed, set(curves))
        return pd.DataFrame({"stamp_id": pdf["stamp_id"].iat[0], "target": pdf["owner"].iat[0], "row": [p[0] for p in chosen], "col": [p[1] for p in chosen], "step": range(len(chosen))})

    kind = pixels.schema["stamp_id"].dataType.simpleString()
    return owned.groupBy("stamp_id", "owner").applyInPandas(run, MASK.format(kind=kind))


def region_grow(pixels: DataFrame, targets: int = 1, min_sep: float = 6.0) -> DataFrame:
    image = mean_image(pixels)
    seeds = peak_seeds(image, targets, min_sep)
    return _grouped(pixels, nearest_seed(image, seeds), seeds, lambda curves, image, seed, allowed: _path(image, seed, allowed))


def watershed_regions(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """(stamp_id, row, col, owner): basins of the smoothed mean image above the threshold; seeds always belong."""
    image = mean_image(pixels)
    rows = image.join(smoothed(image).withColumnRenamed("value", "smooth"), ["stamp_id", "row", "col"]).join(region_threshold(image), "stamp_id")
    rows = rows.join(seeds.select("stamp_id", "row", "col", "target"), ["stamp_id", "row", "col"], "left")

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        at = list(zip(pdf["row"], pdf["col"], strict=True))
        marked = pdf[pdf["target"].notna()].sort_values("target")
        starts = list(zip(marked["row"], marked["col"], strict=True))
        inside = {p for p, v, t in zip(at, pdf["value"], pdf["threshold"], strict=True) if v > t} | set(starts)
        owner = _flood(dict(zip(at, pdf["smooth"], strict=True)), starts, inside)
        return pd.DataFrame([(pdf["stamp_id"].iat[0], *p, k) for p, k in sorted(owner.items())], columns=["stamp_id", "row", "col", "owner"])

    kind = pixels.schema["stamp_id"].dataType.simpleString()
    return rows.groupBy("stamp_id").applyInPandas(flood, f"stamp_id {kind}, row int, col int, owner int")


def grow(pixels: DataFrame, seeds: DataFrame, regions: DataFrame, method: str = "single", least: int = 10) -> DataFrame:
    """Masks by ``single`` growth, up to three ``multi`` components, a bright ``core`` first, or ``exhaustive`` addition."""
    ways = {
        "single": lambda curves, image, seed, allowed: _grow(curves, [seed], allowed, least),
        "multi": lambda curves, image, seed, allowed: _components(curves, image, seed, allowed, least),
        "core": lambda curves, image, seed, allowed: _grow(curves, _core(image, seed, allowed), allowed, least),
        "exhaustive": lambda curves, image, seed, allowed: _exhaustive(curves, image)[0],
    }
    return _grouped(pixels, regions, seeds, ways[method])


def region_mask(regions: DataFrame) -> DataFrame:
    """Whole regions as apertures."""
    return regions.filter("owner >= 0").select("stamp_id", F.col("owner").alias("target"), "row", "col")


def masks_by_mode(pixels: DataFrame, targets: int = 1, mode: str = "auto", radius: float = 2.5, min_sep: float = 6.0, edge: int = 1) -> DataFrame:
    """(stamp_id, mode, target, row, col): by the stamp's mode all its pixels (fullstamp), a circle around its brightest maximum, or
    its middle where it has none (fixedap), or grown regions (apgrow; a stamp without a maximum is taken whole, as
    fullstamp_fallback)."""
    image = stored(mean_image(pixels), "image")
    modes = extraction_mode(image, targets, mode)
    whole = lambda rows, name: rows.join(image.select("stamp_id", "row", "col"), "stamp_id").select("stamp_id", F.lit(name).alias("mode"), F.lit(0).alias("target"), "row", "col")
    full = whole(modes.filter("mode = 'fullstamp'").select("stamp_id"), "fullstamp")
    first = peak_seeds(image, 1, 1.0, edge).select("stamp_id", F.col("row").alias("seed_row"), F.col("col").alias("seed_col"))
    middle = image.groupBy("stamp_id").agg(F.floor((F.max("row") + 1) / 2).alias("mid_row"), F.floor((F.max("col") + 1) / 2).alias("mid_col"))
    centre = modes.filter("mode = 'fixedap'").select("stamp_id").join(middle, "stamp_id").join(first, "stamp_id", "left")
    near = image.join(centre, "stamp_id").filter(in_circle(F.col("row"), F.col("col"), F.coalesce("seed_row", "mid_row"), F.coalesce("seed_col", "mid_col"), radius))
    fixed = near.select("stamp_id", F.lit("fixedap").alias("mode"), F.lit(0).alias("target"), "row", "col")
    growing = modes.filter("mode = 'apgrow'").select("stamp_id")
    seeded = peak_seeds(image, 1, min_sep, edge).select("stamp_id")
    grown = region_grow(pixels.join(growing, "stamp_id", "left_semi"), targets, min_sep).select("stamp_id", F.lit("apgrow").alias("mode"), "target", "row", "col")
    return full.unionByName(fixed).unionByName(grown).unionByName(whole(growing.join(seeded, "stamp_id", "left_anti"), "fullstamp_fallback"))


def levelled_by_segment(sums: DataFrame, times: DataFrame, gap: float) -> DataFrame:
    """Aperture sums over the median of their segment of time (times: stamp_id, cadence, t); without one they have none."""
    rows = sums.join(times, ["stamp_id", "cadence"]).withColumn("k", F.col("cadence"))
    keys = ("stamp_id", "target")
    return gap_segments(rows, gap, "segment", keys).withColumn("flux_rel", level("flux", *keys, "segment", zero="null")).drop("k", "segment")


def levelled_curve(sums: DataFrame) -> DataFrame:
    """Aperture sums over their median by stamp and target."""
    return sums.withColumn("flux_rel", level("flux", "stamp_id", "target"))


def extract(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return levelled_curve(aperture_sums(pixels, mask))
