"""Queries: longer compositions of operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import modes as M
from ..operators import pixels as I
from ..operators import products as X
from ..operators import series as S
from ..operators import spectrum as P
from ..operators import spline as K
from ..functions.text import target_label as label_of
from ..functions.waves import dataset_weight
from ..sources import light_curves as L_
from ..tables import scratch_root, stored
from .images import _positive
from .registry import EVENTS_SQL, LINES_SQL, PCHIP, PCHIP_VALUE, events, lines, query, rounded, table
from .spectra import _NOISE, _SUMS, FMAX, FMIN, SPEC, _named, _spans, _spectrum

E, L = f"WITH {EVENTS_SQL}", f"WITH {LINES_SQL}"


@query(f"{E}, sp AS (SELECT series_id, max(t) - min(t) AS t_full FROM e GROUP BY 1), n AS (SELECT series_id, t_full, CAST(least(greatest(floor(0.2e0 / (1 / t_full / 5)) + 1, 11), 1201) AS BIGINT) AS n FROM sp) SELECT series_id, j, round(0.9e0 + j * ((1.1e0 - 0.9e0) / (n - 1)), 8) AS f FROM (SELECT *, unnest(range(0, n)) AS j FROM n)")
def local_grid(spark: SparkSession, sf: str) -> DataFrame:
    centres = _spans(events(spark, sf)).withColumn("f0", F.lit(1.0))
    return rounded(P.local_grid(centres, F.lit(0.1), 1.0 / F.col("t_full") / 5, FMIN, 50.0).select("series_id", "j", "f"), 8)


@query(f"""{E}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t, k) AS dt FROM e), m AS (SELECT series_id, median(dt) AS dt, count(*) AS n FROM d GROUP BY 1),
sg AS (SELECT *, sum(CASE WHEN dt > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t, k) AS seg FROM d), g AS (SELECT series_id, seg, min(t) AS a, max(t) AS b, count(*) AS n FROM sg GROUP BY ALL),
c AS (SELECT series_id, coalesce(max(b - a) FILTER (n >= 2), max(b) - min(a)) AS chunk, max(b) - min(a) AS span FROM g GROUP BY 1),
p AS (SELECT series_id, least(20e0, greatest(5 / greatest(span, 1e-6), CASE WHEN dt > 0 THEN 0.5e0 / dt ELSE 20e0 END)) AS high, 1 / greatest(chunk, 1e-6) / 5 AS df, greatest(1 / (10 * span), 1 / greatest(chunk, 1e-6) / 5) AS low FROM m JOIN c USING (series_id) WHERE m.n >= 3),
q AS (SELECT *, greatest(0, ceil((high - low) / df)) AS n FROM p), r AS (SELECT series_id, low, CASE WHEN n < 1000 THEN (high - low) / 999 ELSE df END AS step, CAST(CASE WHEN n < 1000 THEN 1000 ELSE n END AS BIGINT) AS n FROM q)
SELECT series_id, j, round(low + j * step, 6) AS f FROM (SELECT *, unnest(range(0, n)) AS j FROM r)""")
def prewhiten_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.nyquist_grid(events(spark, sf)), 6)


@query(f"{SPEC}, {_NOISE} SELECT series_id, j, round(noise, 3) AS noise FROM nz")
def noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    noisy = P.noise_floor(stored(_spectrum(spark, sf), "spectrum"), _spans(events(spark, sf)))
    return rounded(noisy.select("series_id", "j", "noise"), 3)


@query(f"{SPEC}, r AS (SELECT series_id, power, row_number() OVER w AS r, count(*) OVER (PARTITION BY series_id) AS n FROM spec WHERE abs(f - 1) >= 0.1 AND abs(f - 1) <= 0.5 WINDOW w AS (PARTITION BY series_id ORDER BY power)) SELECT series_id, round(median(power), 3) AS noise, max(n) AS n FROM r WHERE r <= greatest(1, floor(0.9e0 * n)) GROUP BY 1")
def local_noise(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    at = e.select("series_id").distinct().withColumn("f0", F.lit(1.0))
    return rounded(P.annulus_noise(_spectrum(spark, sf), at, F.lit(0.1), F.lit(0.4)), 3)


@query(f"""{SPEC}, at_ AS (SELECT series_id, arg_max(f, (power, -j)) AS f0, 1e0 / t_full AS res, greatest(3e0 * (2e0 / t_full), 2e0 * (1e0 / t_full)) AS gd, 15e0 * (1e0 / t_full) AS sd FROM spec JOIN sp USING (series_id) GROUP BY series_id, t_full),
le AS (SELECT *, greatest({FMIN}e0, f0 - (gd + sd)) AS lo, least({FMAX}e0, f0 + (gd + sd)) AS hi FROM at_), ln_ AS (SELECT *, CAST(least(greatest(floor((hi - lo) / (res / 5)) + 1, 11), 1201) AS BIGINT) AS n FROM le),
g2 AS (SELECT series_id, j, lo + j * ((hi - lo) / (n - 1)) AS f FROM (SELECT *, unnest(range(0, n)) AS j FROM ln_)), {_named(_SUMS.format(src="e", night=""), "2")},
aw AS (SELECT spec2.*, f0, gd, sd, abs(f - f0) AS away FROM spec2 JOIN at_ USING (series_id)), pk AS (SELECT series_id, max(power) FILTER (away <= gd) AS p0 FROM aw GROUP BY 1),
an AS (SELECT *, row_number() OVER (PARTITION BY series_id, x ORDER BY power) AS r_, count(*) OVER (PARTITION BY series_id, x) AS m_ FROM (SELECT *, unnest(range(0, 6)) AS x FROM aw) WHERE away >= gd AND away <= gd + pow(1.5e0, x) * sd),
fl AS (SELECT series_id, x, median(power) AS noise, max(m_) AS m FROM an WHERE r_ <= greatest(1, floor(0.9e0 * m_)) GROUP BY ALL), ok AS (SELECT series_id, arg_min(noise, x) AS noise FROM fl WHERE noise > 0 AND m >= 12 GROUP BY 1)
SELECT series_id, round(sqrt(p0 / noise), 4) AS snr, round(p0 / noise, 3) AS w FROM pk JOIN ok USING (series_id)""")
def fit_snr(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    at = stored(P.strongest(_spectrum(spark, sf)), "peaks")
    return rounded(rounded(M.snr_after_fit(e, at, _spans(e), FMIN, FMAX), 4, "snr"), 3, "w")


@query(f"{SPEC}, b AS (SELECT series_id, arg_max(j, (power, -j)) AS j0, arg_max(f, (power, -j)) AS f0, max(power) AS peak, max(f) - min(f) AS span FROM spec GROUP BY 1), n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS near FROM spec JOIN b USING (series_id) WHERE abs(f - f0) <= 0.2 * span), k AS (SELECT *, median(power) OVER (PARTITION BY series_id) AS m FROM n WHERE abs(j - j0) > 2) SELECT series_id, round(CASE WHEN max(near) >= 20 AND count(*) >= 10 THEN (max(peak) - max(m)) / median(abs(power - m)) END, 4) AS snr FROM k GROUP BY 1")
def harmonic_snr(spark: SparkSession, sf: str) -> DataFrame:
    spec = stored(_spectrum(spark, sf), "spectrum")
    return rounded(M.harmonic_snr(spec, P.strongest(spec), share=0.2, guard=2), 4)


@query()
def guided_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("series_id", "t", "y", "k")
    templates = e.select("series_id").distinct().withColumn("f_template", F.explode(F.array(F.lit(0.5), F.lit(1.0)))).withColumn("mode", F.row_number().over(S.by().orderBy("f_template")))
    first = templates.filter("mode = 2").select("series_id", F.col("f_template").alias("f0"))
    after = P.prewhitened(e, P.frequency_fit(e, first, F.lit(0.05), FMIN, FMAX))
    return rounded(X.local_diagnostics(e, stored(after, "after"), templates, 0.1, 0.01, FMIN, FMAX), 6)


@query(f"{L}, kn AS (SELECT series_id, floor(t / 200) * 200 AS x, avg(y) AS v FROM l GROUP BY 1, 2), {PCHIP}, z AS (SELECT k, {PCHIP_VALUE.format(at='l.t')} AS trend FROM l ASOF JOIN iv ON l.series_id = iv.series_id AND l.t >= iv.at) SELECT k, round(trend, 2) AS trend FROM z")
def pchip_eval(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf)
    knots = l.groupBy("series_id", (F.floor(F.col("t") / 200) * 200.0).alias("x")).agg(F.avg("y").alias("v"))
    return rounded(K.pchip(l.select("series_id", "k", "t"), knots, "t", "series_id").select("k", "trend"), 2)


@query()
def polarimetric_products(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("series_id", "t", "y", "k")
    return rounded(X.polarimetric_frame(e, gap=0.01).select("series_id", "k", "nm", "resid", "prewhitened"), 4)


@query()
def extract_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Sources stand at the three brightest pixels of each mean image."""
    px = stored(_positive(spark, sf), "pixels")
    image = stored(I.mean_image(px), "image")
    sky = image.select("stamp_id", "row", "col", (F.col("col") * 0.01).alias("ra"), (F.col("row") * 0.01).alias("dec"))
    rank = F.row_number().over(S.by("stamp_id").orderBy(F.desc("value"), "row", "col"))
    sources = image.withColumn("source_id", rank).filter("source_id <= 3").select("stamp_id", "source_id", (F.col("col") * 0.01).alias("ra"), (F.col("row") * 0.01).alias("dec"), F.col("source_id").alias("mag"))
    return rounded(X.catalogue_extraction(px, sky, sources, 2, "multi", least=30), 5)


@query()
def saturated_route(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf).groupBy("series_id", "k").agg(*[F.max(c).alias(c) for c in ("t", "y", "x", "x2", "b")])
    return rounded(X.saturated_route(l.drop("b"), l.select("series_id", "k", "b"), 0.07), 5)


@query(f"{L} SELECT series_id || '_' || run AS source, k, round(t, 6) AS t, round(y / median(y) OVER (PARTITION BY series_id, run), 6) AS flux FROM l")
def sector_union(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one source levelled on their own, then united by source."""
    parts = [lines(spark, sf).filter(F.col("run") == r) for r in ("A", "N", "R")]
    levelled = [p.select(F.concat(F.col("series_id").cast("string"), F.lit("_"), "run").alias("source"), "k", "t", S.level("y", "series_id", "run").alias("flux")) for p in parts]
    return rounded(rounded(levelled[0].unionByName(levelled[1]).unionByName(levelled[2]), 6, "t", "flux"), 6)


@query()
def batch_series(spark: SparkSession, sf: str) -> DataFrame:
    """The guided search for many series in one plan, users and event types alike; those that are too short say so and stop none."""
    e = events(spark, sf)
    every = e.select(F.concat(F.lit("type "), "series_id").alias("series_id"), "t", "y", "k").unionByName(e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("series_id"), "t", "y", "k"))
    every = stored(every.filter("series_id is not null"), "batch")
    templates = every.select("series_id").distinct().withColumn("f_template", F.explode(F.array(F.lit(0.5), F.lit(1.0)))).withColumn("mode", F.row_number().over(S.by().orderBy("f_template")))
    return rounded(M.batch_search(every, templates), 4)


@query(f"{L}, s AS (SELECT series_id, k, nullif(x, 0) AS a, CASE WHEN run = 'A' THEN x2 END AS b FROM l) SELECT k FROM s WHERE series_id IN (SELECT series_id FROM s WHERE coalesce(a, b) IS NOT NULL)")
def finite_flux_required(spark: SparkSession, sf: str) -> DataFrame:
    l = lines(spark, sf).withColumns({"a": F.nullif("x", F.lit(0)), "b": F.when(F.col("run") == "A", F.col("x2"))})
    return S.with_any_flux(l, "a", "b").select("k")


@query(f"{L}, s AS (SELECT k, series_id, CASE WHEN series_id % 3 = 0 THEN 0 ELSE y END AS y FROM l) SELECT k, round(CASE WHEN median(y) OVER (PARTITION BY series_id) <> 0 THEN y / median(y) OVER (PARTITION BY series_id) END, 6) AS nulled, round(CASE WHEN median(y) OVER (PARTITION BY series_id) <> 0 THEN y / median(y) OVER (PARTITION BY series_id) ELSE y END, 6) AS kept FROM s")
def median_scale_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Every third series has a median of 0: it keeps its values, or has none."""
    l = lines(spark, sf).withColumn("y", F.when(F.col("series_id") % 3 == 0, 0.0).otherwise(F.col("y")))
    return rounded(l.select("k", S.level("y", zero="null").alias("nulled"), S.level("y").alias("kept")), 6)


@query(f"{E}, sg AS (SELECT *, sum(CASE WHEN t - lt > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t, k) AS seg FROM (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY t, k) AS lt FROM e)), g AS (SELECT series_id, seg, min(t) AS a, max(t) AS b, count(*) AS n FROM sg GROUP BY ALL), c AS (SELECT series_id, coalesce(max(b - a) FILTER (n >= 2), max(b) - min(a)) AS chunk FROM g GROUP BY 1) SELECT series_id, mode, round(CASE mode WHEN 'equal' THEN 1 WHEN 'manual' THEN 2.5e0 ELSE CASE WHEN chunk > 0 THEN sqrt(chunk) ELSE 1 END END, 6) AS weight FROM c, (SELECT unnest(['equal', 'sqrt', 'manual']) AS mode)")
def dataset_weight_modes(spark: SparkSession, sf: str) -> DataFrame:
    chunk = S.longest_chunk(events(spark, sf), 1.0)
    each = [F.struct(F.lit(m).alias("mode"), dataset_weight(m, F.col("t_chunk"), 2.5).alias("weight")) for m in ("equal", "sqrt", "manual")]
    return rounded(chunk.select("series_id", F.inline(F.array(*each))), 6)


@query()
def target_label(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for headers: some names look like catalogue numbers, some positions and numbers are missing."""
    c, n = table(spark, sf, "customer"), F.col("c_custkey")
    friendly = F.when(n % 4 == 0, F.col("c_name")).when(n % 4 == 1, F.concat(F.lit("TIC "), n.cast("string"))).when(n % 4 == 2, F.lit(" "))
    number = F.when(n % 3 == 0, n.cast("string"))
    pixel = F.when(n % 7 == 0, F.concat(F.lit("HD_"), n.cast("string"))).otherwise("unknown_target")
    return c.select("c_custkey", label_of(friendly, F.lit(None).cast("string"), pixel, number, F.when(n % 2 == 0, F.col("c_mktsegment"))).alias("label"))


def _as_files(spark: SparkSession, sf: str) -> str:
    """Line items as light-curve files of two kinds of columns, a folder a supplier, in the shared scratch folder."""
    l, path = lines(spark, sf), f"{scratch_root(spark)}/lightloom/curves-{uuid.uuid4().hex}"
    named = l.select("series_id", F.col("t").alias("time_btjd"), F.col("y").alias("flux"), "k")
    kind = F.col("series_id") % 2
    named.filter(kind == 0).withColumnRenamed("flux", "flux_rel").repartition("series_id").write.partitionBy("series_id").option("header", True).csv(f"{path}/raw")
    named.filter(kind == 1).withColumnRenamed("flux", "flux_detrend_rel").repartition("series_id").write.partitionBy("series_id").option("header", True).csv(f"{path}/detrended")
    return path


@query(f"{L} SELECT series_id, count(*) AS n, round(min(y), 4) AS low, round(max(y), 4) AS high, round(max(t) - min(t), 6) AS span, CASE WHEN series_id % 2 = 0 THEN 'flux_rel' ELSE 'flux_detrend_rel' END AS column FROM l GROUP BY 1")
def ingest_lightcurves(spark: SparkSession, sf: str) -> DataFrame:
    """Files written from the table and scanned again, whatever flux column each has."""
    series, _ = L_.read_mixed_directory(spark, _as_files(spark, sf), mode="auto")
    number = F.regexp_extract("series_id", r"series_id=(\d+)", 1).cast("long").alias("series_id")
    own = series.groupBy("series_id").agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("t").alias("span"), F.first("column").alias("column"))
    return rounded(rounded(own.select(number, "n", "low", "high", "span", "column"), 4, "low", "high"), 6, "span")


@query(f"{E}, c AS (SELECT k, t, y, user_id FROM e) SELECT ch AS series_id, count(*) AS n, round(sum(CASE ch WHEN 'q' THEN y WHEN 'u' THEN 2 * y ELSE 3 * y END), 2) AS total, round(max(t) - min(t), 6) AS span FROM c, (SELECT unnest(['q', 'u', 'p']) AS ch) GROUP BY 1")
def ingest_polarimetry(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as files of three channels and read as rows of channels; the span is over all files."""
    path = f"{scratch_root(spark)}/lightloom/channels-{uuid.uuid4().hex}"
    y = F.col("y")
    events(spark, sf).select((F.col("t") + 2450000.0).alias("JD"), y.alias("q"), (2 * y).alias("u"), (3 * y).alias("p"), F.lit(0.1).alias("qe"), "user_id").write.option("header", True).csv(path)
    rows = L_.read_polarimetry(spark, path, "user_id")
    own = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("y").alias("total"), (F.max("jd") - F.min("jd")).alias("span"))
    return rounded(rounded(own, 2, "total"), 6, "span")
