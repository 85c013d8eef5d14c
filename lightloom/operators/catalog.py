"""Joins with catalogues of sources: cones, stamps, nearest pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees (haversine)."""
    r = F.radians
    a = F.pow(F.sin(r(dec2 - dec1) / 2), F.lit(2.0)) + F.cos(r(dec1)) * F.cos(r(dec2)) * F.pow(F.sin(r(ra2 - ra1) / 2), F.lit(2.0))
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def cone_search(centres: DataFrame, catalogue: DataFrame, radius: float) -> DataFrame:
    """Sources within ``radius`` degrees of centres (stamp_id, ra0, dec0), brightest first as ``rank``.

    Declination bands as wide as the radius, and in each band cells of right ascension that are no narrower on the sky,
    make it an equality join with the sources of at most nine cells; the exact distance decides.
    """
    band = lambda d: F.floor((d + 90) / radius)
    #: A band's cells are as wide as a circle of the radius that touches it can be; bands near a pole have one cell.
    top = lambda b: F.greatest(F.abs(b * radius - 90), F.abs((b + 1) * radius - 90)) + radius
    reach = lambda b: F.degrees(F.asin(F.sin(F.radians(F.lit(radius))) / F.cos(F.radians(top(b)))))
    cells = lambda b: F.when(top(b) < 89.9, F.greatest(F.floor(360 / F.coalesce(F.nanvl(reach(b), F.lit(360.0)), F.lit(360.0))), F.lit(1))).otherwise(1).cast("long")
    cell = lambda ra, b: F.floor(F.pmod(ra, F.lit(360.0)) / 360 * cells(b)).cast("long")
    near = centres.withColumn("band_", F.explode(F.array(*[band(F.col("dec0")) + k for k in (-1, 0, 1)])))
    around = F.array_distinct(F.array(*[F.pmod(cell(F.col("ra0"), F.col("band_")) + k, cells(F.col("band_"))) for k in (-1, 0, 1)]))
    near = near.withColumn("cell_", F.explode(around))
    placed = catalogue.withColumn("band_", band(F.col("dec"))).withColumn("cell_", cell(F.col("ra"), F.col("band_")))
    pairs = near.join(placed, ["band_", "cell_"]).drop("band_", "cell_")
    found = pairs.withColumn("sep", separation(F.col("ra0"), F.col("dec0"), F.col("ra"), F.col("dec"))).filter(F.col("sep") <= radius)
    from .series import by

    return found.withColumn("rank", F.row_number().over(by("stamp_id").orderBy("mag", "source_id")))


def pixel_position(wcs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Tangent-plane pixel positions of sources; wcs: stamp_id, ra0, dec0, row0, col0, scale (degrees a pixel)."""
    pairs = wcs.join(catalogue, "stamp_id")
    r = F.radians
    d, d0, dra = r(F.col("dec")), r(F.col("dec0")), r(F.col("ra") - F.col("ra0"))
    cosc = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(dra)
    xi = F.degrees(F.cos(d) * F.sin(dra) / cosc)
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(dra)) / cosc)
    return pairs.withColumn("x", F.col("col0") - xi / F.col("scale")).withColumn("y", F.col("row0") + eta / F.col("scale"))


def in_stamp(positions: DataFrame, rows: int, cols: int) -> DataFrame:
    return positions.filter(F.col("x").between(-0.5, cols - 0.5) & F.col("y").between(-0.5, rows - 0.5))


def nearest_pixel(sky: DataFrame, sources: DataFrame) -> DataFrame:
    """(stamp_id, source_id, row, col, sep): pixels (stamp_id, row, col, ra, dec) nearest to sources."""
    s = sources.select("stamp_id", "source_id", F.col("ra").alias("sra"), F.col("dec").alias("sdec"))
    pairs = sky.join(s, "stamp_id").withColumn("sep", separation(F.col("ra"), F.col("dec"), F.col("sra"), F.col("sdec")))
    best = F.min_by(F.struct("row", "col", "sep"), F.struct("sep", "row", "col"))
    return pairs.groupBy("stamp_id", "source_id").agg(best.alias("b")).select("stamp_id", "source_id", "b.*")
