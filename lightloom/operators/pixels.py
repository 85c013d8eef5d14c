"""Small images and pixel cubes as tables: (stamp_id, cadence, row, col, flux) and (stamp_id, row, col, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.waves import finite
from .series import ROBUST, by

NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def from_cubes(cubes: DataFrame, columns: int, flux: str = "flux") -> DataFrame:
    """One row a pixel and cadence from rows with the whole frame as an array, row by row."""
    keep = [c for c in cubes.columns if c != flux]
    long = cubes.select(*keep, F.posexplode(flux).alias("pos", "flux"))
    return long.select(*keep, F.floor(F.col("pos") / columns).cast("int").alias("row"), (F.col("pos") % columns).alias("col"), finite(F.col("flux")).alias("flux"))


def mean_image(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("stamp_id", "row", "col").agg(F.avg("flux").alias("value"))


def saturated_pixels(image: DataFrame, threshold: float, least: int) -> DataFrame:
    """(stamp_id, n_over, saturated)."""
    over = F.count_if(F.col("value") >= threshold)
    return image.groupBy("stamp_id").agg(over.alias("n_over"), (over >= least).alias("saturated"))


def flat_top(image: DataFrame, share: float = 0.02, of_max: float = 0.5, least: int = 8) -> DataFrame:
    """(stamp_id, flat): the median of the brightest max(least, round(share * n)) pixels exceeds ``of_max`` of the peak."""
    rows = image.filter(F.col("value").isNotNull())
    rank = F.row_number().over(by("stamp_id").orderBy(F.desc("value"), "row", "col"))
    size = F.greatest(F.lit(least), F.bround(share * F.count("*").over(by("stamp_id"))))
    top = rows.withColumn("rank_", rank).withColumn("size_", size).withColumn("peak_", F.max("value").over(by("stamp_id")))
    found = top.filter("rank_ <= size_").groupBy("stamp_id").agg(F.median("value").alias("m"), F.max("peak_").alias("peak"))
    return found.select("stamp_id", ((F.col("peak") > 0) & (F.col("m") > of_max * F.col("peak"))).alias("flat"))


def bright_share(image: DataFrame, of_peak: float = 0.1) -> DataFrame:
    rows = image.filter(F.col("value").isNotNull()).withColumn("peak_", F.max("value").over(by("stamp_id")))
    share = F.avg(F.when(F.col("value") > of_peak * F.col("peak_"), 1.0).otherwise(0.0))
    return rows.groupBy("stamp_id").agg(F.when(F.max("peak_") > 0, share).otherwise(0.0).alias("bright"))


def extraction_mode(image: DataFrame, targets: int = 1, mode: str = "auto", bright: float = 0.25) -> DataFrame:
    """(stamp_id, mode): given, or by saturation: apgrow, fixedap, or fullstamp when bleeding fills the stamp."""
    stats = flat_top(image).join(bright_share(image), "stamp_id")
    if mode != "auto":
        choice = F.lit(mode)
    elif targets > 1:
        choice = F.lit("apgrow")
    else:
        choice = F.when(~F.col("flat"), "apgrow").when(F.col("bright") >= bright, "fullstamp").otherwise("fixedap")
    return stats.select("stamp_id", choice.alias("mode"))


def image_maxima(image: DataFrame, edge: int = 1) -> DataFrame:
    """Pixels that no neighbour exceeds, without the edge rows and columns; edge pixels count for nothing."""
    size = image.withColumn("rows_", F.max("row").over(by("stamp_id"))).withColumn("cols_", F.max("col").over(by("stamp_id")))
    inside = F.col("row").between(edge, F.col("rows_") - edge) & F.col("col").between(edge, F.col("cols_") - edge)
    inner = size.filter(inside & F.col("value").isNotNull()).select("stamp_id", "row", "col", "value")
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])).alias("o")
    around = inner.select("stamp_id", "row", "col", "value", offsets).select("stamp_id", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "value")
    highest = around.groupBy("stamp_id", "row", "col").agg(F.max("value").alias("around"))
    joined = inner.join(highest, ["stamp_id", "row", "col"], "left")
    return joined.filter(F.col("around").isNull() | (F.col("value") >= F.col("around"))).drop("around")


def peak_seeds(image: DataFrame, targets: int, min_sep: float = 6.0, edge: int = 1) -> DataFrame:
    """(stamp_id, target, row, col): brightest maxima first, each at least ``min_sep`` from those before."""
    names = ["rank_", "row", "col", "value"]
    ranked = image_maxima(image, edge).withColumn("rank_", F.row_number().over(by("stamp_id").orderBy(F.desc("value"), "row", "col")))
    kind = ranked.select(F.array(F.struct(*names)).alias("x")).schema["x"].dataType.simpleString()
    away = lambda a, b: (a["row"] - b["row"]) * (a["row"] - b["row"]) + (a["col"] - b["col"]) * (a["col"] - b["col"])
    free = lambda kept, r: (F.size(kept) < targets) & F.forall(kept, lambda k: away(k, r) >= min_sep**2)
    chosen = F.aggregate("rows_", F.array().cast(kind), lambda kept, r: F.when(free(kept, r), F.concat(kept, F.array(r))).otherwise(kept))
    grouped = ranked.groupBy("stamp_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows_"))
    return grouped.select("stamp_id", F.posexplode(chosen).alias("target", "s")).select("stamp_id", "target", "s.row", "s.col", "s.value")


def nearest_seed(image: DataFrame, seeds: DataFrame) -> DataFrame:
    """(stamp_id, row, col, owner): least squared distance, the first seed among equals."""
    listed = seeds.groupBy("stamp_id").agg(F.collect_list(F.struct("target", "row", "col")).alias("seeds_"))
    d = lambda s: F.struct(((F.col("row") - s["row"]) * (F.col("row") - s["row"]) + (F.col("col") - s["col"]) * (F.col("col") - s["col"])).alias("d"), s["target"].alias("owner"))
    return image.join(listed, "stamp_id").select("stamp_id", "row", "col", F.array_min(F.transform("seeds_", d))["owner"].alias("owner"))


def background_by_cadence(pixels: DataFrame, n: int) -> DataFrame:
    """Mean of each cadence's own n faintest pixels."""
    rank = F.row_number().over(by("stamp_id", "cadence").orderBy("flux", "row", "col"))
    faint = pixels.filter(F.col("flux").isNotNull()).withColumn("rank_", rank).filter(F.col("rank_") <= n)
    return faint.groupBy("stamp_id", "cadence").agg(F.avg("flux").alias("background"))


def background_by_image(pixels: DataFrame, n: int) -> DataFrame:
    """Mean over the n faintest pixels of the mean image."""
    rank = F.row_number().over(by("stamp_id").orderBy("value", "row", "col"))
    faint = mean_image(pixels).withColumn("rank_", rank).filter(F.col("rank_") <= n).select("stamp_id", "row", "col")
    return pixels.join(faint, ["stamp_id", "row", "col"]).groupBy("stamp_id", "cadence").agg(F.avg("flux").alias("background"))


def aperture_sums(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(stamp_id, target, cadence, flux, npix) over mask (stamp_id, target, row, col)."""
    inside = pixels.join(mask.select("stamp_id", "target", "row", "col"), ["stamp_id", "row", "col"])
    return inside.groupBy("stamp_id", "target", "cadence").agg(F.coalesce(F.sum("flux"), F.lit(0.0)).alias("flux"), F.count("*").alias("npix"))


def centroids(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    inside = pixels.join(mask.select("stamp_id", "target", "row", "col"), ["stamp_id", "row", "col"])
    total = F.nullif(F.sum("flux"), F.lit(0.0))
    return inside.groupBy("stamp_id", "target", "cadence").agg((F.sum(F.col("flux") * F.col("row")) / total).alias("crow"), (F.sum(F.col("flux") * F.col("col")) / total).alias("ccol"))


def psf_width(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Root of the flux-weighted second moment about the centroid; null where it is no positive number."""
    inside = pixels.join(mask.select("stamp_id", "target", "row", "col"), ["stamp_id", "row", "col"])
    rows = inside.join(centroids(pixels, mask), ["stamp_id", "target", "cadence"])
    r2 = (F.col("row") - F.col("crow")) * (F.col("row") - F.col("crow")) + (F.col("col") - F.col("ccol")) * (F.col("col") - F.col("ccol"))
    var = F.sum(F.col("flux") * r2) / F.nullif(F.sum("flux"), F.lit(0.0))
    return rows.groupBy("stamp_id", "target", "cadence").agg(F.when(var >= 0, F.sqrt(var)).alias("width"))


def mask_union(*masks: DataFrame) -> DataFrame:
    """Pixels (stamp_id, row, col) of any of the masks."""
    every = masks[0].select("stamp_id", "row", "col")
    for mask in masks[1:]:
        every = every.unionByName(mask.select("stamp_id", "row", "col"))
    return every.distinct()


def frontier(mask: DataFrame, allowed: DataFrame) -> DataFrame:
    """The 8-neighbours of a mask that are allowed and not in it."""
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NEIGHBOURS])).alias("o")
    around = mask.select("stamp_id", "target", "row", "col", offsets).select("stamp_id", "target", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).distinct()
    keys = ["stamp_id", "target", "row", "col"]
    return around.join(mask.select(*keys), keys, "left_anti").join(allowed.select("stamp_id", "row", "col"), ["stamp_id", "row", "col"], "left_semi").select(*keys)


def brightest_pixel(image: DataFrame) -> DataFrame:
    """(stamp_id, row, col, value): the first in row order among equals."""
    best = F.max_by(F.struct("row", "col", "value"), F.struct("value", -F.col("row"), -F.col("col")))
    return image.filter(F.col("value").isNotNull()).groupBy("stamp_id").agg(best.alias("b")).select("stamp_id", "b.*")


def region_threshold(image: DataFrame) -> DataFrame:
    """(stamp_id, background, threshold): max(background + robust sigma, background + 2 % of the peak's height)."""
    m = image.withColumn("bg_", F.median("value").over(by("stamp_id")))
    stats = m.groupBy("stamp_id").agg(F.max("bg_").alias("background"), F.median(F.abs(F.col("value") - F.col("bg_"))).alias("mad"), F.max("value").alias("peak"))
    bg = F.col("background")
    return stats.select("stamp_id", "background", F.greatest(bg + ROBUST * F.col("mad"), bg + 0.02 * (F.col("peak") - bg)).alias("threshold"))


def smoothed(image: DataFrame, sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """Gaussian smoothing, mirrored at the edges, as a join-free spread of each pixel over its kernel and one sum."""
    size = image.withColumn("rows_", F.max("row").over(by("stamp_id")) + 1).withColumn("cols_", F.max("col").over(by("stamp_id")) + 1)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = size
    for axis, length in (("row", "rows_"), ("col", "cols_")):
        # where a source pixel and its mirror images reach: positions p with mirror(p + k) = pixel, summed by target
        spread = out.withColumn("to_", F.explode(F.sequence(F.lit(0), F.col(length) - 1)))
        images = [F.col(axis), -F.col(axis) - 1, 2 * F.col(length) - 1 - F.col(axis)]
        weight = sum((F.when(F.abs(p - F.col("to_")) <= reach, F.exp(-0.5 * (p - F.col("to_")) * (p - F.col("to_")) / sigma**2)).otherwise(0.0) for p in images), F.lit(0.0))
        spread = spread.withColumn("w_", weight).filter("w_ > 0")
        other = "col" if axis == "row" else "row"
        total = F.aggregate(F.transform(steps, lambda k: F.exp(-0.5 * k * k / sigma**2)), F.lit(0.0), lambda a, x: a + x)
        out = spread.groupBy("stamp_id", F.col("to_").alias(axis), other, "rows_", "cols_").agg((F.sum(F.col("w_") * F.col("value")) / F.max(total)).alias("value"))
    return out.select("stamp_id", "row", "col", "value")


def cropped_to_common(a: DataFrame, b: DataFrame, value_b: str = "other") -> DataFrame:
    """Both images on the rows and columns that they share."""
    return a.join(b.withColumnRenamed("value", value_b), ["stamp_id", "row", "col"])
