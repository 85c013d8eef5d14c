"""Queries: pixels, apertures, catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apertures as A
from ..operators import catalog as C
from ..operators import pixels as I
from ..tables import stored
from .registry import PIXELS_SQL, pixels, query, rounded, table

P = f"WITH {PIXELS_SQL}"
CIRCLE = '("row" - 3) * ("row" - 3) + (col - 4) * (col - 4) <= 4'


def _positive(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings are centred on zero; fluxes are not."""
    return pixels(spark, sf).withColumn("flux", F.col("flux") + 10)


def _circle(px: DataFrame) -> DataFrame:
    inside = (F.col("row") - 3) * (F.col("row") - 3) + (F.col("col") - 4) * (F.col("col") - 4) <= 4
    return px.select("stamp_id", "row", "col").distinct().filter(inside).withColumn("target", F.lit(0))


@query(f'{P} SELECT stamp_id, "row", col, round(value, 6) AS value FROM im')
def mean_image(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.mean_image(pixels(spark, sf)), 6)


@query(f"{P} SELECT stamp_id, count(*) FILTER (value >= 0.02) AS n_over, count(*) FILTER (value >= 0.02) >= 5 AS saturated FROM im GROUP BY 1")
def saturation_gate(spark: SparkSession, sf: str) -> DataFrame:
    return I.saturated_pixels(I.mean_image(pixels(spark, sf)), 0.02, 5)


_FLAT = f"{P}, r AS (SELECT *, row_number() OVER (PARTITION BY stamp_id ORDER BY value DESC, \"row\", col) AS r, max(value) OVER (PARTITION BY stamp_id) AS peak FROM im), fl AS (SELECT stamp_id, max(peak) > 0 AND median(value) FILTER (r <= 8) > 0.5 * max(peak) AS flat, avg(CASE WHEN value > 0.1 * peak THEN 1.0 ELSE 0.0 END) AS bright FROM r GROUP BY 1)"


@query(f"{_FLAT} SELECT stamp_id, flat FROM fl")
def flat_top_saturation(spark: SparkSession, sf: str) -> DataFrame:
    return I.flat_top(I.mean_image(pixels(spark, sf)))


@query(f"{_FLAT} SELECT stamp_id, round(bright, 6) AS bright FROM fl")
def bright_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.bright_share(I.mean_image(pixels(spark, sf))), 6)


@query(f"{_FLAT} SELECT stamp_id, CASE WHEN NOT flat THEN 'apgrow' WHEN bright >= 0.25 THEN 'fullstamp' ELSE 'fixedap' END AS mode FROM fl")
def extraction_mode(spark: SparkSession, sf: str) -> DataFrame:
    return I.extraction_mode(I.mean_image(pixels(spark, sf)))


_MAXIMA = f'{P}, mx AS (SELECT stamp_id, "row", col, value FROM im a WHERE "row" BETWEEN 1 AND 6 AND col BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM im b WHERE b.stamp_id = a.stamp_id AND b."row" BETWEEN 1 AND 6 AND b.col BETWEEN 1 AND 6 AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND b.value > a.value))'


@query(f'{_MAXIMA} SELECT stamp_id, "row", col FROM mx')
def image_local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return I.image_maxima(I.mean_image(pixels(spark, sf))).select("stamp_id", "row", "col")


_PICKS = f"{_MAXIMA}, r AS (SELECT stamp_id, list([{{'r': \"row\", 'c': col, 'v': value}}] ORDER BY value DESC, \"row\", col) AS rows FROM mx GROUP BY 1), k AS (SELECT stamp_id, list_reduce(rows, lambda kept, x : CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda v : (v.r - x[1].r) * (v.r - x[1].r) + (v.c - x[1].c) * (v.c - x[1].c) < 9)) = 0 THEN list_concat(kept, x) ELSE kept END) AS kept FROM r)"


@query(f"{_PICKS} SELECT stamp_id, CAST(i - 1 AS INTEGER) AS target, kept[i].r AS \"row\", kept[i].c AS col, round(kept[i].v, 6) AS value FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS i FROM k)")
def peak_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.peak_seeds(I.mean_image(pixels(spark, sf)), 3, 3.0), 6)


@query(f'{P}, r AS (SELECT *, row_number() OVER (PARTITION BY stamp_id, cadence ORDER BY flux, "row", col) AS r FROM px) SELECT stamp_id, cadence, round(avg(flux), 6) AS background FROM r WHERE r <= 10 GROUP BY ALL')
def background_faint_cadence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.background_by_cadence(pixels(spark, sf), 10), 6)


@query(f'{P}, r AS (SELECT *, row_number() OVER (PARTITION BY stamp_id ORDER BY value, "row", col) AS r FROM im) SELECT px.stamp_id, cadence, round(avg(flux), 6) AS background FROM px JOIN r USING (stamp_id, "row", col) WHERE r <= 10 GROUP BY ALL')
def background_faint_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.background_by_image(pixels(spark, sf), 10), 6)


@query(f"{P} SELECT stamp_id, 0 AS target, cadence, round(sum(flux), 5) AS flux, count(*) AS npix FROM px WHERE {CIRCLE} GROUP BY ALL")
def aperture_sum(spark: SparkSession, sf: str) -> DataFrame:
    px = pixels(spark, sf)
    return rounded(I.aperture_sums(px, _circle(px)), 5)


_CENTRE = f'{P}, ce AS (SELECT stamp_id, cadence, sum((flux + 10) * "row") / sum(flux + 10) AS crow, sum((flux + 10) * col) / sum(flux + 10) AS ccol FROM px WHERE {CIRCLE} GROUP BY ALL)'


@query(f"{_CENTRE} SELECT stamp_id, 0 AS target, cadence, round(crow, 6) AS crow, round(ccol, 6) AS ccol FROM ce")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    px = _positive(spark, sf)
    return rounded(I.centroids(px, _circle(px)), 6)


@query(f'{_CENTRE} SELECT stamp_id, 0 AS target, cadence, round(sqrt(sum((flux + 10) * (("row" - crow) * ("row" - crow) + (col - ccol) * (col - ccol))) / sum(flux + 10)), 6) AS width FROM px JOIN ce USING (stamp_id, cadence) WHERE {CIRCLE} GROUP BY ALL')
def psf_width(spark: SparkSession, sf: str) -> DataFrame:
    px = _positive(spark, sf)
    return rounded(I.psf_width(px, _circle(px)), 6)


@query(f'{P} SELECT DISTINCT stamp_id, "row", col, {CIRCLE} AS inside FROM im')
def circular_aperture(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.waves import in_circle

    inside = in_circle(F.col("row"), F.col("col"), F.lit(3), F.lit(4), 2.0)
    return pixels(spark, sf).select("stamp_id", "row", "col").distinct().withColumn("inside", inside)


_SEEDS = "(VALUES (0, 1, 1), (1, 5, 2), (2, 3, 6)) s(target, sr, sc)"


@query(f'{P} SELECT stamp_id, "row", col, arg_min(target, ((("row" - sr) * ("row" - sr) + (col - sc) * (col - sc)), target)) AS owner FROM im, {_SEEDS} GROUP BY ALL')
def voronoi_owner(spark: SparkSession, sf: str) -> DataFrame:
    image = I.mean_image(pixels(spark, sf))
    three = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(r).alias("row"), F.lit(c).alias("col")) for t, r, c in ((0, 1, 1), (1, 5, 2), (2, 3, 6))])).alias("s")
    return I.nearest_seed(image, image.select("stamp_id").distinct().select("stamp_id", three).select("stamp_id", "s.*"))


@query(f'{P}, m AS (SELECT DISTINCT stamp_id, "row", col FROM im WHERE {CIRCLE}) SELECT DISTINCT a.stamp_id, 0 AS target, a."row", a.col FROM im a JOIN m ON a.stamp_id = m.stamp_id AND abs(a."row" - m."row") <= 1 AND abs(a.col - m.col) <= 1 WHERE NOT ((a."row" - 3) * (a."row" - 3) + (a.col - 4) * (a.col - 4) <= 4)')
def frontier(spark: SparkSession, sf: str) -> DataFrame:
    px = pixels(spark, sf)
    return I.frontier(_circle(px), px.select("stamp_id", "row", "col").distinct())


@query(f'{P} SELECT stamp_id, arg_max("row", (value, -"row", -col)) AS "row", arg_max(col, (value, -"row", -col)) AS col, round(max(value), 6) AS value FROM im GROUP BY 1')
def extract_single(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.brightest_pixel(I.mean_image(pixels(spark, sf))), 6)


@query(f'{P} SELECT stamp_id, CAST(floor("row" / 4) AS INTEGER) AS target, cadence, round(sum(flux), 5) AS flux, count(*) AS npix FROM px GROUP BY ALL')
def region_aperture(spark: SparkSession, sf: str) -> DataFrame:
    px = pixels(spark, sf)
    regions = px.select("stamp_id", "row", "col").distinct().withColumn("owner", F.floor(F.col("row") / 4).cast("int"))
    return rounded(I.aperture_sums(px, A.region_mask(regions)), 5)


@query(f'{P} SELECT a.stamp_id, a."row", a.col, round(a.value, 6) AS value, round(b.value, 6) AS other FROM im a JOIN im b USING (stamp_id, "row", col) WHERE a."row" < 6 AND b.col < 5')
def grid_crop(spark: SparkSession, sf: str) -> DataFrame:
    image = I.mean_image(pixels(spark, sf))
    return rounded(I.cropped_to_common(image.filter("row < 6"), image.filter("col < 5")), 6)


@query(f'{P} SELECT stamp_id, "row", col FROM im WHERE value > 0 AND "row" < 5 AND NOT ({CIRCLE})')
def mask_setops(spark: SparkSession, sf: str) -> DataFrame:
    px = pixels(spark, sf)
    image = I.mean_image(px)
    keys = ["stamp_id", "row", "col"]
    return image.filter("value > 0").select(*keys).intersect(image.filter("row < 5").select(*keys)).join(_circle(px).select(*keys), keys, "left_anti")


def _seeded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    px = stored(_positive(spark, sf), "pixels")
    seeds = stored(I.brightest_pixel(I.mean_image(px)).select("stamp_id", F.lit(0).alias("target"), "row", "col"), "seeds")
    regions = px.select("stamp_id", "row", "col").distinct().withColumn("owner", F.lit(0))
    return px, seeds, regions


@query()
def region_grow(spark: SparkSession, sf: str) -> DataFrame:
    return A.region_grow(stored(_positive(spark, sf), "pixels"), 2, 3.0)


@query()
def watershed_regions(spark: SparkSession, sf: str) -> DataFrame:
    px = stored(_positive(spark, sf), "pixels")
    return A.watershed_regions(px, I.peak_seeds(I.mean_image(px), 3, 3.0))


@query()
def aperture_grow(spark: SparkSession, sf: str) -> DataFrame:
    return A.grow(*_seeded(spark, sf), "single")


@query()
def aperture_grow_multi(spark: SparkSession, sf: str) -> DataFrame:
    return A.grow(*_seeded(spark, sf), "multi")


@query()
def aperture_core(spark: SparkSession, sf: str) -> DataFrame:
    return A.grow(*_seeded(spark, sf), "core")


@query()
def aperture_saturated(spark: SparkSession, sf: str) -> DataFrame:
    return A.exhaustive_aperture(stored(_positive(spark, sf), "pixels"))[0]


@query()
def aperture_saturated_figures(spark: SparkSession, sf: str) -> DataFrame:
    """What the exhaustive aperture of each stamp is made of, with and without the older geometry rule."""
    px = stored(_positive(spark, sf), "pixels")
    old, new = (A.exhaustive_aperture(px, legacy=x)[1] for x in (True, False))
    return rounded(old.unionByName(new), 8)


@query()
def aperture_grow_signed(spark: SparkSession, sf: str) -> DataFrame:
    """Fluxes on both sides of zero, as after the background is taken away."""
    px = stored(pixels(spark, sf), "pixels")
    seeds = stored(I.brightest_pixel(I.mean_image(px)).select("stamp_id", F.lit(0).alias("target"), "row", "col"), "seeds")
    return A.grow(px, seeds, px.select("stamp_id", "row", "col").distinct().withColumn("owner", F.lit(0)), "single")


@query()
def extract_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Each stamp by its own mode; curves over the median of their segment."""
    px = stored(_positive(spark, sf), "pixels")
    masks = A.masks_by_mode(px)
    times = px.select("stamp_id", "cadence").distinct().withColumn("t", F.col("cadence").cast("double"))
    return rounded(A.levelled_by_segment(I.aperture_sums(px, masks), times, 50.0).select("stamp_id", "target", "cadence", "flux", "npix", "flux_rel"), 5)


@query(f'{P} SELECT DISTINCT stamp_id, "row", col FROM im WHERE value > 0.02 OR {CIRCLE}')
def mask_union(spark: SparkSession, sf: str) -> DataFrame:
    px = pixels(spark, sf)
    return I.mask_union(I.mean_image(px).filter("value > 0.02"), _circle(px))


_SKY = "sky AS (SELECT s_suppkey AS source_id, s_suppkey % 360 + 0.25e0 AS ra, (s_suppkey * 7) % 120 - 60 + 0.5e0 AS \"dec\", s_acctbal AS mag FROM supplier), ce AS (SELECT n_nationkey AS stamp_id, n_nationkey * 3e0 AS ra0, n_nationkey - 12e0 AS dec0 FROM nation)"
_SEP = "degrees(2 * asin(sqrt(least(1, pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians({r2} - {r1}) / 2), 2)))))"


def _sky(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("source_id"), (k % 360 + 0.25).alias("ra"), ((k * 7) % 120 - 60 + 0.5).alias("dec"), F.col("s_acctbal").alias("mag"))


def _centres(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.alias("stamp_id"), (n * 3.0).alias("ra0"), (n - 12.0).alias("dec0"))


@query(f"WITH {_SKY}, p AS (SELECT *, {_SEP.format(d1='dec0', d2='\"dec\"', r1='ra0', r2='ra')} AS sep FROM ce, sky) SELECT stamp_id, source_id, round(sep, 6) AS sep, row_number() OVER (PARTITION BY stamp_id ORDER BY mag, source_id) AS rank FROM p WHERE sep <= 20")
def cone_search(spark: SparkSession, sf: str) -> DataFrame:
    found = C.cone_search(_centres(spark, sf), _sky(spark, sf), 20.0)
    return rounded(found.select("stamp_id", "source_id", "sep", F.col("rank").cast("long").alias("rank")), 6)


@query(f"""WITH {_SKY}, q AS (SELECT stamp_id, source_id, radians("dec") AS d, radians(dec0) AS d0, radians(ra - ra0) AS da FROM ce JOIN sky ON source_id % 25 = stamp_id),
z AS (SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(da) AS cc FROM q),
xy AS (SELECT stamp_id, source_id, 4 - degrees(cos(d) * sin(da) / cc) / 5e0 AS x, 4 + degrees((cos(d0) * sin(d) - sin(d0) * cos(d) * cos(da)) / cc) / 5e0 AS y FROM z)
SELECT stamp_id, source_id, round(x, 4) AS x, round(y, 4) AS y FROM xy WHERE x BETWEEN -0.5 AND 7.5 AND y BETWEEN -0.5 AND 7.5""")
def in_stamp_sources(spark: SparkSession, sf: str) -> DataFrame:
    wcs = _centres(spark, sf).withColumns({"row0": F.lit(4.0), "col0": F.lit(4.0), "scale": F.lit(5.0)})
    sky = _sky(spark, sf).withColumn("stamp_id", (F.col("source_id") % 25).cast("int"))
    return rounded(C.in_stamp(C.pixel_position(wcs, sky), 8, 8).select("stamp_id", "source_id", "x", "y"), 4)


@query(f"""WITH {_SKY}, pxs AS (SELECT stamp_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, ra0 + c * 2e0 AS ra1, dec0 + r * 2e0 AS dec1 FROM ce, range(0, 8) a(r), range(0, 8) b(c)),
d AS (SELECT p.stamp_id, source_id, "row", col, {_SEP.format(d1='dec1', d2='s."dec"', r1='ra1', r2='s.ra')} AS sep FROM pxs p JOIN sky s ON source_id % 25 = stamp_id)
SELECT stamp_id, source_id, arg_min("row", (sep, "row", col)) AS "row", arg_min(col, (sep, "row", col)) AS col, round(min(sep), 5) AS sep FROM d GROUP BY ALL""")
def nearest_pixel(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(0), F.lit(7)))
    grid = _centres(spark, sf).withColumn("row", steps).withColumn("col", steps)
    grid = grid.select("stamp_id", "row", "col", (F.col("ra0") + F.col("col") * 2.0).alias("ra"), (F.col("dec0") + F.col("row") * 2.0).alias("dec"))
    return rounded(C.nearest_pixel(grid, _sky(spark, sf).withColumn("stamp_id", (F.col("source_id") % 25).cast("int"))), 5)
