"""Monotone cubic (PCHIP) interpolation through knots, in windows and one as-of union; templates and high-pass filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .series import by


def knot_slopes(knots: DataFrame, *keys: str) -> DataFrame:
    """knots (keys, x, v) with the slope d, and the step h and rise m to the next knot."""
    w = Window.partitionBy(*keys).orderBy("x")
    k = knots.withColumn("h", F.lead("x").over(w) - F.col("x")).withColumn("m", (F.lead("v").over(w) - F.col("v")) / F.nullif(F.col("h"), F.lit(0.0)))
    k = k.withColumns({"h0": F.lag("h").over(w), "m0": F.lag("m").over(w), "h2": F.lead("h").over(w), "m2": F.lead("m").over(w), "hp": F.lag("h", 2).over(w), "mp": F.lag("m", 2).over(w)})
    h, m, h0, m0 = (F.col(c) for c in ("h", "m", "h0", "m0"))
    w1, w2 = 2 * h + h0, h + 2 * h0
    inner = F.when(m0 * m <= 0, 0.0).otherwise((w1 + w2) / (w1 / F.nullif(m0, F.lit(0.0)) + w2 / F.nullif(m, F.lit(0.0))))

    def end(ha: Column, ma: Column, hb: Column, mb: Column) -> Column:
        d = ((2 * ha + hb) * ma - ha * mb) / (ha + hb)
        d = F.when(F.signum(d) != F.signum(ma), 0.0).when((F.signum(ma) != F.signum(mb)) & (F.abs(d) > 3 * F.abs(ma)), 3 * ma).otherwise(d)
        return F.when(mb.isNull(), ma).otherwise(d)  # two knots: a line

    slope = F.when(h0.isNull(), end(h, m, F.col("h2"), F.col("m2"))).when(h.isNull(), end(h0, m0, F.col("hp"), F.col("mp"))).otherwise(inner)
    return k.withColumn("d", slope).select(*keys, "x", "v", "h", "d")


def pchip(points: DataFrame, knots: DataFrame, x: str, *keys: str, name: str = "trend") -> DataFrame:
    """points with the interpolant at column ``x``; outside the knots the end cubics go on; null without two knots.

    Points and knots are united and sorted once per key; the last knot at or before a point gives its interval.
    """
    w = Window.partitionBy(*keys).orderBy("x")
    k = knot_slopes(knots, *keys)
    k = k.withColumns({"v1": F.lead("v").over(w), "d1": F.lead("d").over(w)})
    k = k.withColumn("first_", F.row_number().over(w) == 1).filter("h is not null")
    piece = F.struct("x", "h", "v", "v1", "d", "d1")
    starts = k.select(*keys, F.when(F.col("first_"), F.lit(float("-inf"))).otherwise(F.col("x")).alias("at_"), piece.alias("piece_"), F.lit(0).alias("kind_"))
    rows = points.select(*keys, F.col(x).cast("double").alias("at_"), F.struct("*").alias("row_"), F.lit(1).alias("kind_"))
    both = starts.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("piece_", F.last("piece_", ignorenulls=True).over(order)).filter("kind_ = 1")
    p = F.col("piece_")
    s = (F.col("at_") - p["x"]) / p["h"]
    value = (
        (1 + 2 * s) * (1 - s) * (1 - s) * p["v"] + s * s * (3 - 2 * s) * p["v1"]
        + p["h"] * s * (1 - s) * (1 - s) * p["d"] - p["h"] * s * s * (1 - s) * p["d1"]
    )
    return both.withColumn(name, value).select("row_.*", name)


def highpass(series: DataFrame, spacing: float, y: str = "y", least: int = 3) -> DataFrame:
    """y - trend + median(trend), the trend a PCHIP through medians around knots every ``spacing`` from the first time."""
    near = series.withColumn("b_", F.floor((F.col("t") - F.min("t").over(by())) / spacing + 0.5)).withColumn("t0_", F.min("t").over(by()))
    knots = near.groupBy("series_id", "b_").agg(F.median(y).alias("v"), (F.min("t0_") + F.col("b_") * spacing).alias("x"))
    knots = knots.withColumn("n_", F.count("*").over(by())).filter(F.col("n_") >= least).select("series_id", "x", "v")
    out = pchip(series, knots, "t", "series_id")
    return out.withColumn("highpass", F.coalesce(F.col(y) - F.col("trend") + F.median("trend").over(by()), F.col(y)))


def template(series: DataFrame, phase: str, width: float, least: int, y: str = "y") -> DataFrame:
    """series with ``trend``: bin means over a phase column, tiled over three turns, PCHIP; null under ``least`` bins."""
    bins = series.groupBy("series_id", F.floor(F.col(phase) / width).alias("b_")).agg(F.avg(y).alias("v"))
    bins = bins.withColumn("n_", F.count("*").over(by())).filter(F.col("n_") >= least)
    tiled = bins.withColumn("turn_", F.explode(F.array(*[F.lit(k) for k in (-1.0, 0.0, 1.0)])))
    knots = tiled.select("series_id", ((F.col("b_") + 0.5) * width + F.col("turn_")).alias("x"), "v")
    return pchip(series, knots, phase, "series_id")


def template_detrended(series: DataFrame, phase: str, width: float = 0.01, least: int = 4, y: str = "y") -> DataFrame:
    out = template(series, phase, width, least, y)
    return out.withColumn("detrended", F.coalesce(F.col(y) - F.col("trend") + F.median(y).over(by()), F.col(y)))
