"""Queries: periodograms, noise, peaks, regressions, splines and modes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import waves
from ..operators import modes as M
from ..operators import regress as R
from ..operators import series as S
from ..operators import spectrum as P
from ..operators import spline as K
from ..tables import stored
from .basics import SEG
from .registry import EVENTS_SQL, LINES_SQL, PCHIP, PCHIP_VALUE, events, lines, query, rounded

#: Frequencies of all spectra, in cycles a day, and the most points of a grid.
FMIN, FMAX, POINTS = 0.01, 50.0, 60_000
#: Steps of a local fit.
STEPS = 1001

_GRID = f"""sp AS (SELECT series_id, max(t) - min(t) AS t_full FROM e GROUP BY 1),
st AS (SELECT series_id, t_full, floor(({FMAX}e0 - {FMIN}e0) / (1 / t_full / 3e0)) + 1 AS n, 1 / t_full / 3e0 AS df FROM sp),
g AS (SELECT series_id, j, {FMIN}e0 + j * CASE WHEN n > {POINTS} THEN ({FMAX}e0 - {FMIN}e0) / {POINTS - 1} ELSE df END AS f
  FROM (SELECT *, unnest(range(0, CAST(least(n, {POINTS}) AS BIGINT))) AS j FROM st))"""
_SUMS = """su AS (SELECT series_id, j, f, {night} count(*) AS n, sum(y) AS y1, sum(s) AS s1, sum(c) AS c1, sum(s * s) AS s2, sum(c * c) AS c2, sum(s * c) AS sc, sum(y * s) AS ys, sum(y * c) AS yc, sum(y * y) AS yy
  FROM (SELECT e.*, j, f, sin(2 * pi() * f * t) AS s, cos(2 * pi() * f * t) AS c FROM {src} e JOIN g USING (series_id)) GROUP BY ALL),
ce AS (SELECT series_id, j, f, sum(s2 - s1 * s1 / n) AS a, sum(c2 - c1 * c1 / n) AS b, sum(sc - s1 * c1 / n) AS d, sum(ys - y1 * s1 / n) AS p, sum(yc - y1 * c1 / n) AS q, sum(yy - y1 * y1 / n) AS r FROM su GROUP BY ALL),
fit AS (SELECT *, (b * p - d * q) / (a * b - d * d) AS s, (a * q - d * p) / (a * b - d * d) AS c FROM ce),
spec AS (SELECT series_id, j, f, s, c, r, s * p + c * q AS gain, (s * p + c * q) / 2 AS power FROM fit)"""
E = f"WITH {EVENTS_SQL}"
SPEC = f"{E}, {_GRID}, {_SUMS.format(src='e', night='')}"


def _spans(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg((F.max("t") - F.min("t")).alias("t_full"))


def _grid(series: DataFrame) -> DataFrame:
    return P.frequency_grid(_spans(series), FMIN, FMAX, oversample=3.0, most=POINTS)


def _spectrum(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return P.lomb_scargle(e, _grid(e))


@query(f"{E}, {_GRID} SELECT series_id, j, round(f, 8) AS f FROM g")
def frequency_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_grid(events(spark, sf)), 8)


@query(f"{SPEC} SELECT series_id, j, round(power, 3) AS power FROM spec")
def lomb_scargle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_spectrum(spark, sf), 3).select("series_id", "j", "power")


@query(f"{SPEC} SELECT series_id, arg_max(j, (power, -j)) AS j, round(arg_max(f, (power, -j)), 6) AS f, round(max(power), 3) AS power FROM spec GROUP BY 1")
def strongest_peak(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(P.strongest(_spectrum(spark, sf)), 6, "f"), 3, "power")


@query(f"{SPEC} SELECT series_id, j, round(sqrt(s * s + c * c), 5) AS amp, round(gain / r, 7) AS power FROM spec")
def amplitude_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    p = P.nuisance_periodogram(e, _grid(e))
    return rounded(rounded(p.select("series_id", "j", waves.amplitude(F.col("s_coeff"), F.col("c_coeff")).alias("amp"), "power"), 5, "amp"), 7, "power")


_NIGHT = f"{E}, {_GRID}, en AS (SELECT *, floor(t) AS night FROM e), {_SUMS.format(src='en', night='night,')}"


@query(f"{_NIGHT} SELECT series_id, j, round(greatest(0, gain / r), 7) AS power FROM spec")
def nuisance_periodogram(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("night", F.floor("t"))
    return rounded(P.nuisance_periodogram(e, _grid(e), "night").select("series_id", "j", "power"), 7)


_SLOPES = f"""{E}, {_GRID}, en AS (SELECT *, floor(t) AS night, t - avg(t) OVER (PARTITION BY series_id, floor(t)) AS u FROM e),
su AS (SELECT series_id, j, f, night, count(*) AS n, sum(y) AS y1, sum(s) AS s1, sum(c) AS c1, sum(s * s) AS s2, sum(c * c) AS c2, sum(s * c) AS sc, sum(y * s) AS ys, sum(y * c) AS yc, sum(y * y) AS yy,
  sum(u * u) AS uu, sum(u * y) AS uy, sum(u * s) AS us, sum(u * c) AS uc
  FROM (SELECT en.*, j, f, sin(2 * pi() * f * t) AS s, cos(2 * pi() * f * t) AS c FROM en JOIN g USING (series_id)) GROUP BY ALL),
o AS (SELECT *, CASE WHEN uu > 0 THEN 1 / uu ELSE 0 END AS iu FROM su),
ce AS (SELECT series_id, j, f, sum(s2 - s1 * s1 / n - us * us * iu) AS a, sum(c2 - c1 * c1 / n - uc * uc * iu) AS b, sum(sc - s1 * c1 / n - us * uc * iu) AS d, sum(ys - y1 * s1 / n - uy * us * iu) AS p, sum(yc - y1 * c1 / n - uy * uc * iu) AS q, sum(yy - y1 * y1 / n - uy * uy * iu) AS r FROM o GROUP BY ALL)"""


@query(f"{_SLOPES} SELECT series_id, j, round(greatest(0, (p * (b * p - d * q) + q * (a * q - d * p)) / (a * b - d * d) / r), 7) AS power FROM ce")
def nuisance_periodogram_slopes(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("night", F.floor("t"))
    return rounded(P.nuisance_periodogram(e, _grid(e), "night", slopes=True).select("series_id", "j", "power"), 7)


#: Events with an error a point (by the user) and nights; the weighted sums by night about their weighted means and slopes.
_WEIGHTED = """ew AS (SELECT *, floor(t) AS night, 1e0 / ((1 + user_id % 5) * (1 + user_id % 5)) AS w FROM e),
en AS (SELECT *, t - sum(w * t) OVER (PARTITION BY series_id, night) / sum(w) OVER (PARTITION BY series_id, night) AS u FROM ew),
su AS (SELECT series_id, j, f, night, count(*) AS m, sum(w) AS n, sum(w * y) AS y1, sum(w * s) AS s1, sum(w * c) AS c1, sum(w * s * s) AS s2, sum(w * c * c) AS c2, sum(w * s * c) AS sc, sum(w * y * s) AS ys, sum(w * y * c) AS yc, sum(w * y * y) AS yy,
  sum(w * u * u) AS uu, sum(w * u * y) AS uy, sum(w * u * s) AS us, sum(w * u * c) AS uc
  FROM (SELECT en.*, j, f, sin(2 * pi() * f * t) AS s, cos(2 * pi() * f * t) AS c FROM en JOIN g USING (series_id)) GROUP BY ALL),
o AS (SELECT *, CASE WHEN uu > 0 THEN 1 / uu ELSE 0 END AS iu FROM su),
ce AS (SELECT series_id, j, f, sum(m) AS m, count(*) AS nights, sum(s2 - s1 * s1 / n - us * us * iu) AS a, sum(c2 - c1 * c1 / n - uc * uc * iu) AS b, sum(sc - s1 * c1 / n - us * uc * iu) AS d, sum(ys - y1 * s1 / n - uy * us * iu) AS p, sum(yc - y1 * c1 / n - uy * uc * iu) AS q, sum(yy - y1 * y1 / n - uy * uy * iu) AS r FROM o GROUP BY ALL),
fit AS (SELECT *, (b * p - d * q) / (a * b - d * d) AS s, (a * q - d * p) / (a * b - d * d) AS c FROM ce),
sg AS (SELECT *, (r - s * p - c * q) / greatest(m - 2 - 2 * nights, 1) / (a * b - d * d) AS v FROM fit)"""


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumns({"night": F.floor("t"), "yerr": (1 + F.col("user_id") % 5).cast("double")})
    return P.with_weights(e, "yerr")


_NIGHTLY = P.Baseline("night", slopes=True, weight="weight")


@query(f"{E}, {_GRID}, {_WEIGHTED} SELECT series_id, j, round(greatest(0, (s * p + c * q) / r), 7) AS power FROM fit")
def weighted_periodogram(spark: SparkSession, sf: str) -> DataFrame:
    """Points with errors; an offset and a slope a night."""
    e = _weighted(spark, sf)
    return rounded(P.nuisance_periodogram(e, _grid(e), _NIGHTLY).select("series_id", "j", "power"), 7)


_LOCAL_GRID = "g AS (SELECT series_id, j, 0.9e0 + j * ((1.1e0 - 0.9e0) / 1000) AS f FROM (SELECT DISTINCT series_id FROM e), (SELECT unnest(range(0, 1001)) AS j))"


@query(f"""{E}, {_LOCAL_GRID}, {_WEIGHTED}, best AS (SELECT series_id, arg_min(j, (r - s * p - c * q, j)) AS j FROM sg GROUP BY 1)
SELECT series_id, round(f, 6) AS f, round(sqrt(s * s + c * c), 5) AS amp, round(atan2(c, s), 5) AS phase, round(sqrt((s * s * b - 2 * s * c * d + c * c * a) * v / (s * s + c * c)), 5) AS amp_err,
  round(sqrt((c * c * b + 2 * s * c * d + s * s * a) * v) / (s * s + c * c), 5) AS phase_err FROM best JOIN sg USING (series_id, j)""")
def fit_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A frequency fit to points with errors beside nightly offsets and slopes, with the errors of amplitude and phase."""
    e = _weighted(spark, sf)
    at = e.select("series_id").distinct().withColumn("f0", F.lit(1.0))
    fit = P.with_errors(P.frequency_fit(e, at, F.lit(0.1), FMIN, FMAX, STEPS, _NIGHTLY))
    return rounded(rounded(fit.select("series_id", "f", "amp", "phase", "amp_err", "phase_err"), 6, "f"), 5, "amp", "phase", "amp_err", "phase_err")


@query(f"{SPEC}, z AS (SELECT series_id, j, s1 * s1 + c1 * c1 AS z FROM su) SELECT series_id, j, round(z / max(z) OVER (PARTITION BY series_id), 6) AS power FROM z")
def spectral_window(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return rounded(P.spectral_window(e, _grid(e)).select("series_id", "j", "power"), 6)


_NOISE = f"""wd AS (SELECT series_id, 3e0 * (2e0 / t_full) AS gd, greatest(15e0 * (1e0 / t_full), 30e0 * (fb - fa) / (n - 1)) AS sd FROM sp JOIN (SELECT series_id, min(f) AS fa, max(f) AS fb, count(*) AS n FROM g GROUP BY 1) USING (series_id)),
pairs AS (SELECT a.series_id, a.j, b.power AS p2, row_number() OVER w AS r, count(*) OVER (PARTITION BY a.series_id, a.j) AS m
  FROM spec a JOIN wd ON a.series_id = wd.series_id JOIN spec b ON a.series_id = b.series_id AND ((b.f >= a.f - (gd + sd) AND b.f <= a.f - gd) OR (b.f >= a.f + gd AND b.f <= a.f + (gd + sd))) WINDOW w AS (PARTITION BY a.series_id, a.j ORDER BY b.power)),
nz AS (SELECT series_id, j, median(p2) AS noise FROM pairs WHERE r <= greatest(1, floor(0.9e0 * m)) GROUP BY ALL)"""


@query(f"{SPEC}, {_NOISE} SELECT series_id, j, round(noise, 3) AS noise, round(power / noise, 4) AS white FROM spec JOIN nz USING (series_id, j)")
def whitened_power(spark: SparkSession, sf: str) -> DataFrame:
    w = P.whitened(stored(_spectrum(spark, sf), "spectrum"), _spans(events(spark, sf)))
    return rounded(rounded(w.select("series_id", "j", "noise", "white"), 3, "noise"), 4, "white")


@query(f"{SPEC}, {_NOISE}, best AS (SELECT series_id, arg_max(j, (power, -j)) AS j FROM spec GROUP BY 1) SELECT series_id, round(sqrt(power / noise), 4) AS snr FROM best JOIN spec USING (series_id, j) JOIN nz USING (series_id, j)")
def local_snr(spark: SparkSession, sf: str) -> DataFrame:
    spec, spans = stored(_spectrum(spark, sf), "spectrum"), _spans(events(spark, sf))
    at = P.strongest(spec).select("series_id", F.col("f").alias("f0")).join(spans, "series_id").join(M._bins(spec), "series_id")
    guard, side = P.KFIT * (2.0 / F.col("t_full")), F.greatest(P.SIDES * (1.0 / F.col("t_full")), P.SIDE_BINS * F.col("bin_"))
    return rounded(M.snr_at(spec, at, guard, side).select("series_id", "snr"), 4)


@query(f"{SPEC}, n AS (SELECT *, quantile_cont(power, 0.99) OVER (PARTITION BY series_id) AS p FROM spec) SELECT series_id, j, round(power / p, 5) AS norm FROM n")
def spectrum_norm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.normalised(_spectrum(spark, sf)).select("series_id", "j", "norm"), 5)


@query()
def top_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.top_peaks(_spectrum(spark, sf), 10, 0.1), 4)


@query(f"{SPEC}, best AS (SELECT series_id, arg_max(f, (power, -j)) AS f0 FROM spec GROUP BY 1) SELECT series_id, j FROM spec JOIN best USING (series_id) WHERE abs(f - f0) > 0.1")
def exclusion_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    spec = stored(_spectrum(spark, sf), "spectrum")
    return P.excluded(spec, P.strongest(spec), 0.1).select("series_id", "j")


@query(f"{E}, {SEG.format(gap=1, src='e')}, g AS (SELECT series_id, segment, min(t) AS a, max(t) AS b, count(*) AS n FROM seg GROUP BY ALL), c AS (SELECT series_id, coalesce(max(b - a) FILTER (n >= 2), max(b) - min(a)) AS t_chunk FROM g GROUP BY 1) SELECT series_id, round(CASE WHEN t_chunk > 0 THEN sqrt(t_chunk) ELSE 1 END, 6) AS weight FROM c")
def dataset_weight(spark: SparkSession, sf: str) -> DataFrame:
    chunk = S.longest_chunk(events(spark, sf), 1.0)
    return rounded(chunk.select("series_id", waves.dataset_weight("sqrt", F.col("t_chunk")).alias("weight")), 6)


_LOCAL = f"{E}, {_LOCAL_GRID}, {_SUMS.format(src='e', night='')}"


@query(f"{_LOCAL}, best AS (SELECT series_id, arg_min(j, (r - gain, j)) AS j FROM spec GROUP BY 1) SELECT series_id, round(f, 6) AS f, round(s, 5) AS s_coeff, round(c, 5) AS c_coeff FROM best JOIN spec USING (series_id, j)")
def frequency_fit(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    at = e.select("series_id").distinct().withColumn("f0", F.lit(1.0))
    fit = P.frequency_fit(e, at, F.lit(0.1), FMIN, FMAX, steps=STEPS)
    return rounded(rounded(fit.select("series_id", "f", "s_coeff", "c_coeff"), 6, "f"), 5, "s_coeff", "c_coeff")


@query(f"""{_LOCAL}, best AS (SELECT series_id, arg_min(j, (r - gain, j)) AS j FROM spec GROUP BY 1), bf AS (SELECT series_id, f, s, c FROM best JOIN spec USING (series_id, j)),
w AS (SELECT series_id, k, y - (s * sin(2 * pi() * f * t) + c * cos(2 * pi() * f * t)) AS r FROM e JOIN bf USING (series_id)) SELECT k, round(r - avg(r) OVER (PARTITION BY series_id), 5) AS y FROM w""")
def prewhiten(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    at = e.select("series_id").distinct().withColumn("f0", F.lit(1.0))
    return rounded(P.prewhitened(e, P.frequency_fit(e, at, F.lit(0.1), FMIN, FMAX, steps=STEPS)).select("k", "y"), 5)


@query()
def sequential_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Event values are noise, so the limit is low: the loop runs its rounds."""
    found = M.sequential_modes(events(spark, sf), FMIN, FMAX, snr_stop=1.0)
    return rounded(found, 4)


#: Greedy choice in SQL: rows in order as a list, reduced to those that stay away from what was kept.
_GREEDY = "list_reduce({rows}, lambda kept, x : CASE WHEN len(list_filter(kept, lambda v : abs(v.f - x[1].f) < {sep}e0)) = 0 THEN list_concat(kept, x) ELSE kept END)"


@query(f"{SPEC}, r AS (SELECT series_id, list([{{'j': j, 'f': f}}] ORDER BY power DESC, f) AS rows FROM spec WHERE power > 1 GROUP BY 1), k AS (SELECT series_id, {_GREEDY.format(rows='rows', sep='0.15')} AS kept FROM r) SELECT series_id, x.j AS j FROM (SELECT series_id, unnest(kept) AS x FROM k)")
def dedupe_modes(spark: SparkSession, sf: str) -> DataFrame:
    spec = _spectrum(spark, sf).filter("power > 1").withColumn("snr", F.sqrt("power")).withColumn("amp", F.lit(0.0)).withColumn("w", F.col("power"))
    return M.deduped(spec.select("series_id", "j", "f", "snr", "amp", "w"), 0.15).select("series_id", "j")


@query(f"{SPEC}, m AS (SELECT *, sqrt(s * s + c * c) AS amp FROM spec WHERE power > 3), ch AS (SELECT *, sum(CASE WHEN f - lf >= 0.03 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY f, j) AS chain FROM (SELECT *, lag(f) OVER (PARTITION BY series_id ORDER BY f, j) AS lf FROM m)) SELECT series_id, arg_max(j, (amp, -f)) AS mode FROM ch GROUP BY series_id, chain")
def collapse_modes(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    fit = P.nuisance_periodogram(e, _grid(e)).join(P.lomb_scargle(e, _grid(e)).select("series_id", "j", F.col("power").alias("psd")), ["series_id", "j"]).filter("psd > 3")
    modes = fit.select("series_id", F.col("j").alias("mode"), "f", waves.amplitude(F.col("s_coeff"), F.col("c_coeff")).alias("amp"))
    return M.collapsed(modes, 0.03).select("series_id", "mode")


@query(f"{SPEC}, e2 AS (SELECT series_id, 0 AS source, j, f, power FROM spec WHERE power > 400 UNION ALL SELECT series_id, 1, j, f, power FROM spec WHERE power > 100), r AS (SELECT series_id, list([{{'j': j, 'f': f, 'source': source}}] ORDER BY source, power DESC, f) AS rows FROM e2 GROUP BY 1), k AS (SELECT series_id, {_GREEDY.format(rows='rows', sep='0.1')} AS kept FROM r) SELECT series_id, x.j AS j, x.source AS source FROM (SELECT series_id, unnest(kept) AS x FROM k)")
def merge_peaks(spark: SparkSession, sf: str) -> DataFrame:
    spec = stored(_spectrum(spark, sf), "spectrum").withColumnRenamed("power", "height")
    return M.merged_peaks([spec.filter("height > 400"), spec.filter("height > 100")], 0.1).select("series_id", "j", "source")


@query()
def greedy_mode_match(spark: SparkSession, sf: str) -> DataFrame:
    spec = stored(_spectrum(spark, sf), "spectrum")
    rank = F.row_number().over(S.by().orderBy(F.desc("power"), "j"))
    local = S.local_maxima(spec, "power", "j").withColumn("rank", rank).filter("rank <= 20")  # as many modes as a search gives
    local = local.select("series_id", F.row_number().over(S.by().orderBy("f")).alias("mode"), "f")
    parts = spec.withColumn("rank", rank).filter("rank <= 25").select("series_id", (F.col("f") + 0.003).alias("f"), F.col("power").alias("amp"), F.lit(0.0).alias("phase"))
    return rounded(M.matched(local, parts), 5)


@query()
def global_refine(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    fit = stored(P.nuisance_periodogram(e, _grid(e)), "spectrum")
    rank = F.row_number().over(S.by().orderBy(F.desc("power"), "j"))
    modes = fit.withColumn("mode", rank).filter("mode <= 20").select("series_id", "mode", "f")  # a search gives up to 20
    return rounded(M.global_refinement(e, modes, _spans(e)).drop("rss"), 4)


@query()
def guided_search(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    templates = e.select("series_id").distinct().withColumn("f_template", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(0.01)))).withColumn("mode", F.row_number().over(S.by().orderBy("f_template")))
    return rounded(M.guided_search(e, templates, _spans(e), snr_min=0.5), 4)


@query()
def multiharmonic_ls(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return rounded(M.multiharmonic_power(e, _grid(e)), 6)


@query()
def harmonic_prewhiten(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("series_id", "t", "y", "k")
    grid = P.frequency_grid(_spans(e), FMIN, 20.0, oversample=4.0, most=100_000)
    return rounded(M.harmonic_prewhitened(e, grid, stop=0.5).select("k", "y"), 4)


@query()
def joint_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """A target's photometry are its events of even number, its polarimetry, with nights and errors, those of odd number. Both are
    noise, whose peaks reach an SNR of about 3."""
    e = _weighted(spark, sf).select("series_id", "t", "y", "k", "night", "weight").filter("series_id is not null")
    even = F.col("k") % 2 == 0
    out = M.joint_modes(e.filter(even).drop("night", "weight"), e.filter(~even), FMIN, FMAX, P.Baseline("night", weight="weight"), snr_stop=3.0)
    return rounded(out, 4)


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf).select("series_id", "t", "y", "k")
    return e.filter("k % 2 = 0"), e.filter("k % 2 = 1")


def _named(ctes: str, tag: str) -> str:
    """CTEs under names of their own."""
    return re.sub(r"\b(su|ce|fit|spec|g|nz|pairs|wd|sp)\b", lambda m: m[1] + tag, ctes)


@query(f"""{E}, h AS (SELECT *, k % 2 AS half FROM e), sp AS (SELECT series_id, max(t) - min(t) AS t_full FROM h WHERE half = 0 GROUP BY 1), sp1 AS (SELECT series_id, max(t) - min(t) AS t_full FROM h WHERE half = 1 GROUP BY 1),
{_GRID.partition("st AS")[1] + _GRID.partition("st AS")[2].replace("FROM sp)", "FROM (SELECT series_id, max(t) - min(t) AS t_full FROM e GROUP BY 1))")}, h0 AS (SELECT * FROM h WHERE half = 0), h1 AS (SELECT * FROM h WHERE half = 1),
{_SUMS.format(src="e", night="")}, best AS (SELECT series_id, arg_max(f, (power, -j)) AS f0 FROM spec GROUP BY 1),
g0 AS (SELECT series_id, j, greatest({FMIN}e0, f0 - 3 * 0.03e0) + j * (0.03e0 / 10) AS f FROM (SELECT *, unnest(range(0, CAST(floor((least({FMAX}e0, f0 + 3 * 0.03e0) - greatest({FMIN}e0, f0 - 3 * 0.03e0)) / (0.03e0 / 10)) + 1 AS BIGINT))) AS j FROM best)), g1 AS (SELECT * FROM g0),
{_named(_SUMS.format(src="h0", night=""), "0")}, sp0 AS (SELECT * FROM sp), {_named(_NOISE, "0")},
{_named(_SUMS.format(src="h1", night=""), "1").replace("(s * p + c * q) / 2 AS power", "greatest(0, (s * p + c * q) / r) AS power")}, {_named(_NOISE, "1").replace("15e0", "10e0")},
f0_ AS (SELECT series_id, median(power) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power) AS r_, count(*) OVER (PARTITION BY series_id) AS m_ FROM spec0) WHERE r_ <= greatest(1, floor(0.9e0 * m_)) GROUP BY 1),
f1_ AS (SELECT series_id, median(power) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power) AS r_, count(*) OVER (PARTITION BY series_id) AS m_ FROM spec1) WHERE r_ <= greatest(1, floor(0.9e0 * m_)) GROUP BY 1),
sc AS (SELECT a.series_id, a.j, a.f, exp((ln(greatest(a.power / CASE WHEN n0.noise > 0 THEN n0.noise ELSE f0_.whole END, 1e-30)) + ln(greatest(b.power / CASE WHEN n1.noise > 0 THEN n1.noise ELSE f1_.whole END, 1e-30))) / 2) AS score
  FROM spec0 a JOIN spec1 b ON a.series_id = b.series_id AND a.j = b.j JOIN f0_ ON f0_.series_id = a.series_id JOIN f1_ ON f1_.series_id = a.series_id LEFT JOIN nz0 n0 ON n0.series_id = a.series_id AND n0.j = a.j LEFT JOIN nz1 n1 ON n1.series_id = a.series_id AND n1.j = a.j)
SELECT series_id, round(arg_max(f, (score, -j)), 4) AS f, round(max(score), 3) AS score FROM sc GROUP BY 1""")
def refine_peak(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select("series_id", "t", "y", "k")
    start = stored(P.strongest(P.lomb_scargle(e, _grid(e))).select("series_id", F.col("f").alias("f0")), "start")
    out = M.refined_peak(*_halves(spark, sf), start, F.lit(0.03), FMIN, FMAX)
    return rounded(rounded(out, 4, "f"), 3, "score")


_TYPES = ("click", "error", "purchase", "signup", "view")
_ABOUT = """us AS (SELECT user_id, event_type, CAST(epoch_us(ts) AS DOUBLE) / 8.64e10 AS t, value AS y FROM events WHERE user_id IS NOT NULL),
md AS (SELECT CAST(user_id AS VARCHAR) AS series_id, event_type AS channel, 10e0 / (2 + count(*) % 37) AS f, avg(y) AS amp, stddev_pop(y) AS amp_err, 0.001e0 * sum(y) / 7 AS phase, 0.01e0 * count(*) AS phase_err,
  1e0 * count(*) AS snr, 10e0 / (2 + count(*) % 37) + 0.001e0 AS f2, max(y) AS amp2, min(y) AS amp_err2, 0.002e0 * sum(y) / 7 AS phase2, 0.02e0 * count(*) AS phase_err2, max(y) - min(y) AS snr2 FROM us GROUP BY user_id, event_type)"""


def _summary_modes(spark: SparkSession, sf: str) -> DataFrame:
    """A mode for each user (the target) and event type (the channel), with figures of their events."""
    e = events(spark, sf).filter("user_id is not null")
    n, y = F.count("*"), F.col("y")
    f = F.lit(10.0) / (2 + n % 37)
    told = {"f": f, "amp": F.avg(y), "amp_err": F.stddev_pop(y), "phase": 0.001 * F.sum(y) / 7, "phase_err": 0.01 * n, "snr": 1.0 * n, "f2": f + 0.001, "amp2": F.max(y), "amp_err2": F.min(y), "phase2": 0.002 * F.sum(y) / 7, "phase_err2": 0.02 * n, "snr2": F.max(y) - F.min(y)}
    return e.groupBy(F.col("user_id").cast("string").alias("series_id"), F.col("series_id").alias("channel")).agg(*[c.alias(k) for k, c in told.items()])


@query(f"""WITH {_ABOUT}, st AS (SELECT series_id, list([{{'f': f, 'amp': amp, 'amp_err': amp_err, 'phase': phase, 'phase_err': phase_err}}] ORDER BY snr DESC, amp DESC, f) AS rows FROM md WHERE snr >= 2 GROUP BY 1),
kp AS (SELECT series_id, unnest(list_reduce(rows, lambda kept, x : CASE WHEN len(list_filter(kept, lambda v : abs(v.f - x[1].f) < 0.05e0)) = 0 THEN list_concat(kept, x) ELSE kept END)) AS m FROM st),
nr AS (SELECT series_id, m, row_number() OVER (PARTITION BY series_id ORDER BY m.f) AS mode FROM kp),
ne AS (SELECT nr.series_id, nr.mode, channel, arg_min({{'f': f2, 'a': amp2, 'e': amp_err2, 'p': phase2, 'q': phase_err2}}, (abs(md.f - m.f), -snr2)) AS b FROM nr JOIN md USING (series_id) GROUP BY ALL)
SELECT nr.series_id, nr.mode, round(m.f, 4) AS f, round(1 / m.f, 4) AS period, round(1000 * m.amp, 4) AS amp_ppt, round(1000 * m.amp_err, 4) AS amp_err_ppt, round(m.phase, 4) AS phase, round(m.phase_err, 4) AS phase_err, """ + ", ".join(
    f"round({c}.b.f, 4) AS {c}_f, round(1 / {c}.b.f, 4) AS {c}_period, round({c}.b.a, 4) AS {c}_amp, round({c}.b.e, 4) AS {c}_amp_err, round({c}.b.p, 4) AS {c}_phase, round({c}.b.q, 4) AS {c}_phase_err" for c in _TYPES
) + " FROM nr " + " ".join(f"LEFT JOIN ne {c} ON {c}.series_id = nr.series_id AND {c}.mode = nr.mode AND {c}.channel = '{c}'" for c in _TYPES))
def joint_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.joint_summary(stored(_summary_modes(spark, sf), "modes"), _TYPES, 0.05), 4)


@query(f"{SPEC}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, j) AS rank FROM spec), b AS (SELECT * FROM r WHERE rank <= 2) SELECT e.series_id, rank, k, round(t * f - floor(t * f), 5) AS phase, round(y + s * sin(2 * pi() * f * t) + c * cos(2 * pi() * f * t), 4) AS signal FROM e JOIN b USING (series_id)")
def phased_modes(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    fit = P.nuisance_periodogram(e, _grid(e)).join(P.lomb_scargle(e, _grid(e)).select("series_id", "j", F.col("power").alias("amp")), ["series_id", "j"])
    out = M.isolated_modes(e, fit.select("series_id", "f", "amp", "s_coeff", "c_coeff"), 2)
    return rounded(rounded(out.select("series_id", F.col("rank").cast("long").alias("rank"), "k", "phase", "signal"), 5, "phase"), 4, "signal")


L = f"WITH {LINES_SQL}"


@query(f"{L}, f AS (SELECT series_id, regr_slope(y, t) AS m, regr_intercept(y, t) AS a0 FROM l GROUP BY 1) SELECT k, round(y - (a0 + m * t), 2) AS y FROM l JOIN f USING (series_id)")
def poly_detrend(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.poly_detrended(lines(spark, sf), 1).select("k", "y"), 2)


@query(f"{L}, m AS (SELECT *, b - median(b) OVER (PARTITION BY series_id) AS bc FROM l), f AS (SELECT series_id, regr_slope(y, bc) AS m, regr_intercept(y, bc) AS a, median(y) AS med FROM m GROUP BY 1) SELECT k, round(CASE WHEN count(*) OVER (PARTITION BY series_id) > 590 THEN y - (a + m.bc * f.m) + med ELSE y END, 2) AS decorrelated FROM m JOIN f USING (series_id)")
def ols_decorrelate(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of about 600 lines: those with 590 at most keep their values."""
    rows, names = R.hinge_features(lines(spark, sf), ["b"])
    return rounded(R.decorrelated(rows, names, "y", R.least_squares(rows, names, "y"), least=590).select("k", "decorrelated"), 2)


_KNOTS = "d AS (SELECT *, min(t) OVER w AS t0, max(t) OVER w AS t1, median(x) OVER w AS mx, median(x2) OVER w AS mx2, median(b) OVER w AS mb FROM l WINDOW w AS (PARTITION BY series_id))"


@query(f"{L}, {_KNOTS} SELECT k, round(x - mx, 6) AS x_c, round(x2 - mx2, 6) AS x2_c, round(b - mb, 6) AS b_c, round(coalesce(list_sum([CASE WHEN t0 + 100e0 * i < t1 AND t > t0 + 100e0 * i THEN t - (t0 + 100e0 * i) ELSE 0 END FOR i IN range(1, 100)]), 0), 4) AS hinge_sum FROM d")
def design_hinge(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = R.hinge_features(lines(spark, sf), ["x", "x2", "b"], spacing=100.0)
    hinge = sum((F.col(n) for n in names if n.startswith("hinge")), F.lit(0.0)).alias("hinge_sum")
    return rounded(rounded(rows.select("k", "x_c", "x2_c", "b_c", hinge), 6, "x_c", "x2_c", "b_c"), 4, "hinge_sum")


@query()
def robust_decorrelate(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = R.hinge_features(lines(spark, sf), ["x", "x2", "b"])
    return rounded(R.decorrelated(rows, names, "y", R.robust_fit(rows, names, "y")).select("k", "decorrelated"), 2)


@query()
def robust_decorrelate_conv(spark: SparkSession, sf: str) -> DataFrame:
    """The whole design: positions, times, width, hinges and background."""
    l = lines(spark, sf).withColumn("width", F.col("b") * F.col("x"))
    rows, names = R.extractor_features(l, "x", "x2", "b", "width", 500.0)
    return rounded(R.decorrelated(rows, names, "y", R.robust_fit(rows, names, "y", stop=True)).select("k", "decorrelated"), 2)


@query()
def split_regression(spark: SparkSession, sf: str) -> DataFrame:
    """The half before and the half after the middle; a half of fewer than 200 points stays as it is."""
    rows = lines(spark, sf).withColumn("half", F.col("t") >= F.percentile("t", F.lit(0.5)).over(S.by()))
    return rounded(R.split_decorrelated(rows, "x", "x2", "b", "half").select("k", "decorrelated"), 2)


@query(f"""{L}, m AS (SELECT series_id, median(y) AS my, median(b) AS mb, count(*) AS n FROM l GROUP BY 1),
g AS (SELECT series_id, i, i * (2 * my / mb) / 199 AS mult FROM m, (SELECT unnest(range(0, 200)) AS i) WHERE n >= 100 AND mb <> 0),
z AS (SELECT series_id, i, mult, y - mult * b AS rest, y - mult * b - lag(y - mult * b) OVER (PARTITION BY series_id, i ORDER BY t, k) AS dy FROM l JOIN g USING (series_id)),
q AS (SELECT series_id, i, mult, stddev_pop(dy) / CASE WHEN median(rest) <> 0 THEN abs(median(rest)) ELSE 1 END AS noise FROM z GROUP BY ALL)
SELECT m.series_id, round(coalesce(arg_min(mult, (noise, i)), 0), 3) AS k FROM m LEFT JOIN q USING (series_id) GROUP BY 1""")
def background_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.background_scale(lines(spark, sf), "b"), 3)


@query(f"{L}, l0 AS (SELECT *, min(t) OVER (PARTITION BY series_id) AS t0 FROM l), kn AS (SELECT series_id, min(t0) + floor((t - t0) / 300 + 0.5e0) * 300 AS x, median(y) AS v FROM l0 GROUP BY series_id, floor((t - t0) / 300 + 0.5e0)), {PCHIP}, z AS (SELECT k, l.series_id, y, {PCHIP_VALUE.format(at='l.t')} AS trend FROM l ASOF JOIN iv ON l.series_id = iv.series_id AND l.t >= iv.at) SELECT k, round(y - trend + median(trend) OVER (PARTITION BY series_id), 2) AS highpass FROM z")
def pchip_highpass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.highpass(lines(spark, sf), 300.0).select("k", "highpass"), 2)


_TEMPLATE = "b AS (SELECT series_id, floor(ph / 0.05e0) AS bn, avg(y) AS v FROM f GROUP BY ALL), kn AS (SELECT series_id, (bn + 0.5e0) * 0.05e0 + turn AS x, v FROM b, (SELECT unnest([-1, 0, 1]) AS turn))"
_TREND = f"z AS (SELECT k, f.series_id, y, {PCHIP_VALUE.format(at='f.ph')} AS trend FROM f ASOF JOIN iv ON f.series_id = iv.series_id AND f.ph >= iv.at)"


@query(f"{E}, f AS (SELECT *, t * 0.7e0 - floor(t * 0.7e0) AS ph FROM e), {_TEMPLATE}, {PCHIP}, {_TREND} SELECT k, round(y - trend + median(y) OVER (PARTITION BY series_id), 4) AS detrended FROM z")
def phase_template_detrend(spark: SparkSession, sf: str) -> DataFrame:
    folded = events(spark, sf).withColumn("phase", waves.fold(F.col("t"), F.lit(0.7)))
    return rounded(K.template_detrended(folded, "phase", 0.05).select("k", "detrended"), 4)


@query(f"{E}, q AS (SELECT *, t - (floor(min(t) OVER (PARTITION BY series_id)) + 0.5e0) AS d FROM e), f AS (SELECT *, d - floor(d) AS ph FROM q), {_TEMPLATE}, {PCHIP}, {_TREND} SELECT k, round(y - trend, 4) AS residual FROM z")
def daily_template_residual(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    daily = e.withColumn("phase", F.pmod(F.col("t") - (F.floor(F.min("t").over(S.by())) + 0.5), F.lit(1.0)))
    out = K.template(daily, "phase", 0.05, 3)
    return rounded(out.select("k", (F.col("y") - F.coalesce("trend", F.lit(0.0))).alias("residual")), 4)


@query(f"{L}, m AS (SELECT series_id AS s1, k, t FROM l WHERE run = 'A'), o AS (SELECT series_id AS s2, k AS k2, t AS t2 FROM l WHERE run = 'R') SELECT s1 AS series_id, k, round(min(abs(t - t2)), 5) AS away FROM m JOIN o ON s1 = s2 GROUP BY s1, k, t")
def nearest_mode_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's nearest row of another kind, from the last one before and the first one after."""
    l = lines(spark, sf).filter("run in ('A', 'R')")
    w = S.by().orderBy("t")
    other = F.when(F.col("run") == "R", F.col("t"))
    near = l.withColumn("a", F.last(other, True).over(w.rangeBetween(S.Window.unboundedPreceding, 0))).withColumn("b", F.first(other, True).over(w.rangeBetween(0, S.Window.unboundedFollowing)))
    away = F.least(F.col("t") - F.col("a"), F.col("b") - F.col("t"))
    return rounded(near.filter("run = 'A'").groupBy("series_id", "k", "t").agg(F.min(away).alias("away")).filter("away is not null").select("series_id", "k", "away"), 5)
