"""Compositions: grids and tests around fits, polarimetric products, catalogue and saturated-star extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.waves import fold
from ..tables import stored
from . import apertures, catalog, pixels
from .modes import harmonic_prewhitened
from .regress import background_scale, decorrelated, extractor_features, robust_fit, split_decorrelated
from .series import by, gap_segments, level, longest_chunk, ordered
from .spectrum import Baseline, local_grid, nuisance_periodogram
from .spline import template, template_detrended


def nyquist_grid(series: DataFrame, oversample: int = 5, gap: float = 1.0, highest: float = 20.0, least: int = 1000) -> DataFrame:
    """(series_id, j, f): steps of 1 / (longest chunk * oversample) up to min(highest, max(5 / span, Nyquist of the median
    step)); a grid of fewer than ``least`` points becomes ``least`` even ones."""
    steps = series.withColumn("dt_", F.col("t") - F.lag("t").over(ordered())).groupBy("series_id").agg(F.median("dt_").alias("dt"), F.count("*").alias("n"))
    s = steps.join(longest_chunk(series, gap), "series_id").filter("n >= 3")
    nyquist = F.when(F.col("dt") > 0, 0.5 / F.nullif("dt", F.lit(0.0))).otherwise(highest)
    high = F.least(F.lit(highest), F.greatest(5.0 / F.greatest(F.col("t_full"), F.lit(1e-6)), nyquist))
    df = 1.0 / F.greatest(F.col("t_chunk"), F.lit(1e-6)) / oversample
    s = s.withColumn("high", high).withColumn("df", df).withColumn("low", F.greatest(1.0 / (10 * F.col("t_full")), F.col("df")))
    s = s.withColumn("n", F.greatest(F.lit(0), F.ceil((F.col("high") - F.col("low")) / F.col("df"))))
    few = F.col("n") < least
    s = s.withColumn("step", F.when(few, (F.col("high") - F.col("low")) / (least - 1)).otherwise(F.col("df"))).withColumn("n", F.when(few, least).otherwise(F.col("n")))
    return s.select("series_id", "low", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("j")).select("series_id", "j", (F.col("low") + F.col("j") * F.col("step")).alias("f"))


def local_diagnostics(first: DataFrame, last: DataFrame, templates: DataFrame, half: float | Column, df: float | Column, fmin: float, fmax: float, baseline: Baseline | str | None = None) -> DataFrame:
    """Spectra before and after a guided search around each template: series_id, mode, j, f, before, after."""
    centres = templates.filter(F.col("f_template") >= fmin).withColumnRenamed("f_template", "f0")
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    key = F.concat_ws("|", F.col("mode").cast("string"), F.col("series_id").cast("string"))  # a series for each template
    grid = local_grid(centres, column(half), column(df), fmin, fmax).select(key.alias("key_"), "series_id", "mode", "j", "f")
    names = stored(centres.select("series_id", "mode", key.alias("key_")), "templates")
    own = grid.select(F.col("key_").alias("series_id"), "j", "f")
    powers = []
    for s, n in ((first, "before"), (last, "after")):
        rows = s.join(names.select("series_id", "key_"), "series_id").drop("series_id").withColumnRenamed("key_", "series_id")
        powers.append(nuisance_periodogram(rows, own, baseline).select(F.col("series_id").alias("key_"), "j", "f", F.col("power").alias(n)))
    both = powers[0].join(powers[1].drop("f"), ["key_", "j"])
    return both.join(names, "key_").select("series_id", "mode", "j", "f", "before", "after")


def polarimetric_frame(channels: DataFrame, gap: float = 0.4, rounds: int = 3, harmonics: int = 5, grid_points: int = 1000) -> DataFrame:
    """channels (series_id, t, y, k): nights, night means removed (nm), the daily template removed (resid), harmonics
    removed (prewhitened)."""
    nights = gap_segments(channels, gap, "night")
    nm = nights.withColumn("nm", F.col("y") - F.avg("y").over(by("series_id", "night")))
    daily = nm.withColumn("phase1d", F.pmod(F.col("t") - (F.floor(F.min("t").over(by())) + 0.5), F.lit(1.0)))
    resid = template(daily, "phase1d", 0.05, 3, "nm").withColumn("resid", F.col("nm") - F.coalesce("trend", F.lit(0.0))).drop("trend")
    resid = stored(resid, "products")
    series = resid.withColumns({"raw_": F.col("y"), "y": F.col("resid")})  # all columns go along: nothing is joined back
    clean = harmonic_prewhitened(series, stored(nyquist_grid(series.select("series_id", "t", "y", "k"), least=grid_points), "grid"), rounds, harmonics)
    return clean.withColumn("prewhitened", F.col("y")).withColumn("y", F.col("raw_")).drop("raw_")


def catalogue_extraction(px: DataFrame, sky: DataFrame, sources: DataFrame, targets: int = 2, method: str = "multi", least: int = 1000) -> DataFrame:
    """Brightest sources of each stamp -> nearest pixels -> watershed regions -> growth -> light curve, centroid and width, level,
    and the levelled curve less its robust regression on position, width and time (``decorrelated``), where a curve has more than
    ``least`` good points. Sources outside their stamp's frame are left out. sky: stamp_id, row, col, ra, dec; sources: stamp_id, source_id, ra, dec, mag."""
    rank = F.row_number().over(by("stamp_id").orderBy("mag", "source_id"))
    frame = sky.groupBy("stamp_id").agg(*[f(c).alias(f"{c}_{n}") for c in ("ra", "dec") for n, f in (("low", F.min), ("high", F.max))])
    held = sources.join(frame, "stamp_id").filter("ra between ra_low and ra_high and dec between dec_low and dec_high")  # the frame's box on the sky
    best = held.withColumn("target", rank - 1).filter(F.col("target") < targets)
    at = catalog.nearest_pixel(sky, best).join(best.select("stamp_id", "source_id", "target"), ["stamp_id", "source_id"])
    one = F.row_number().over(by("stamp_id", "row", "col").orderBy("target"))  # two sources in one pixel are the brighter
    seeds = stored(at.withColumn("one_", one).filter("one_ = 1").select("stamp_id", "target", "row", "col").withColumn("target", (F.row_number().over(by("stamp_id").orderBy("target")) - 1).cast("int")), "seeds")
    regions = stored(apertures.watershed_regions(px, seeds), "regions")
    mask = stored(apertures.grow(px, seeds, regions, method, 3), "mask")
    keys = ["stamp_id", "target"]
    curve = apertures.extract(px, mask).join(pixels.centroids(px, mask), [*keys, "cadence"]).join(pixels.psf_width(px, mask), [*keys, "cadence"])
    curve = stored(curve.withColumns({"series_id": F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), "t": F.col("cadence").cast("double"), "k": F.col("cadence")}), "curves")
    whole = curve.filter("crow is not null and ccol is not null and width is not null and flux_rel is not null")
    rows, names = extractor_features(whole, "crow", "ccol", width="width")
    rows = stored(rows, "design")
    flat = decorrelated(rows, names, "flux_rel", robust_fit(rows, names, "flux_rel", stop=True), least=least).select("series_id", "cadence", "decorrelated")
    return curve.join(flat, ["series_id", "cadence"], "left").drop("series_id", "t", "k")


def saturated_route(curves: DataFrame, background: DataFrame, frequency: float, mid: float | None = None, rounds: int = 8) -> DataFrame:
    """curves (series_id, t, y, x, x2, k) and background (series_id, k, b): the best multiple of the background goes, then
    the template at the orbital frequency, then a robust fit before and after the middle; flux relative to the median."""
    rows = stored(curves.join(background, ["series_id", "k"]), "saturated")
    scaled = rows.join(background_scale(rows, "b").withColumnRenamed("k", "mult"), "series_id")
    scaled = scaled.withColumn("y", F.col("y") - F.col("mult") * F.col("b")).drop("mult").withColumn("phase", fold(F.col("t"), F.lit(frequency)))
    flat = template_detrended(scaled, "phase", 0.05).withColumn("y", F.col("detrended")).drop("detrended", "trend", "phase")
    half = F.col("t") >= (F.percentile("t", F.lit(0.5)).over(by()) if mid is None else F.lit(mid))
    out = split_decorrelated(stored(flat.withColumn("half", half), "flat"), "x", "x2", "b", "half", rounds=rounds)
    return out.withColumn("flux_rel", level("decorrelated")).select("series_id", "t", "k", "flux_rel")
