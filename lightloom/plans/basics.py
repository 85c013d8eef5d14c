"""Queries: cleaning, predicates, segments, aggregates, waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import waves
from ..operators import series as S
from .registry import EVENTS_SQL, LINES_SQL, events, lines, query, rounded, table

E, L = f"WITH {EVENTS_SQL}", f"WITH {LINES_SQL}"


@query(f"{E} SELECT series_id, round(t, 6) AS t, y, k FROM e WHERE isfinite(y)")
def clean_sort_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.clean(events(spark, sf)).select("series_id", "t", "y", "k"), 6, "t")


@query(f"{L} SELECT series_id, k, y FROM l WHERE isfinite(y) AND x > 0")
def clean_with_errors(spark: SparkSession, sf: str) -> DataFrame:
    return S.clean(lines(spark, sf), err="x").select("series_id", "k", "y")


@query(f"{E} SELECT k, round(t - min(t) OVER (PARTITION BY series_id), 6) AS t_rel FROM e")
def relative_time(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events(spark, sf).select("k", S.relative_time().alias("t_rel")), 6)


@query(f"{L} SELECT series_id, k, run FROM l WHERE b % 5 = 0")
def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).withColumn("quality", (F.col("b") % 5).cast("int"))
    return S.good_quality(rows).select("series_id", "k", "run")


@query(f"{E}, q AS (SELECT *, user_id % 7 AS quality, series_id || user_id AS s FROM e), c AS (SELECT *, count(*) FILTER (quality = 0) OVER (PARTITION BY s) AS good FROM q) SELECT s AS series_id, k FROM c WHERE good = 0 OR quality = 0")
def quality_filter_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("quality", F.col("user_id") % 7).withColumn("series_id", F.concat("series_id", F.col("user_id").cast("string")))
    return S.good_quality_or_all(rows).select("series_id", "k")


@query(f"{E} SELECT k, CASE WHEN count(CASE WHEN series_id <> 'view' THEN y END) OVER (PARTITION BY series_id) > 0 THEN CASE WHEN series_id <> 'view' THEN y END ELSE -y END AS flux FROM e")
def main_flux_choice(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("corrected", F.when(F.col("series_id") != "view", F.col("y"))).withColumn("raw", -F.col("y"))
    return rows.select("k", S.main_flux(rows, "corrected", "raw").alias("flux"))


@query(f"{E}, a AS (SELECT *, CASE WHEN series_id < 'e' THEN t + 2460000 ELSE t END AS ta FROM e) SELECT k, round(CASE WHEN median(ta) OVER (PARTITION BY series_id) > 1e6 THEN ta - 2457000 ELSE ta END, 5) AS t_abs FROM a")
def absolute_time_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("t_abs", F.when(F.col("series_id") < "e", F.col("t") + 2460000).otherwise(F.col("t")))
    return rounded(rows.select("k", S.absolute_time().alias("t_abs")), 5)


@query(f"{L} SELECT k, y FROM l WHERE x IS NOT NULL AND x2 IS NOT NULL AND b IS NOT NULL AND isfinite(y)")
def joint_finite_mask(spark: SparkSession, sf: str) -> DataFrame:
    return S.clean(lines(spark, sf)).dropna(subset=["x", "x2", "b"]).select("k", "y")


SEG = "seg AS (SELECT *, CAST(sum(CASE WHEN t - lt > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY t, k) AS BIGINT) AS segment FROM (SELECT *, lag(t) OVER (PARTITION BY series_id ORDER BY t, k) AS lt FROM {src}))"


@query(f"{L}, {SEG.format(gap=20, src='l')} SELECT k, segment FROM seg")
def gap_segments(spark: SparkSession, sf: str) -> DataFrame:
    return S.gap_segments(lines(spark, sf), 20.0).select("k", "segment")


@query(f"{E}, {SEG.format(gap=0.01, src='e')} SELECT k, segment AS night FROM seg")
def night_groups_gap(spark: SparkSession, sf: str) -> DataFrame:
    return S.gap_segments(events(spark, sf), 0.01, "night").select("k", "night")


@query(f"{E} SELECT k, dense_rank() OVER (PARTITION BY series_id ORDER BY floor(t)) - 1 AS night FROM e")
def night_groups_integer(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("k", S.day_groups().cast("long").alias("night"))


@query(f"{L}, m AS (SELECT *, coalesce(nullif(run, 'N'), '__') AS r FROM l), f AS (SELECT series_id, r, min((t, k)) AS first FROM m GROUP BY ALL), g AS (SELECT series_id, r, dense_rank() OVER (PARTITION BY series_id ORDER BY first) - 1 AS night FROM f) SELECT k, night FROM m JOIN g USING (series_id, r)")
def run_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).withColumn("run", F.nullif("run", F.lit("N")))
    return S.label_groups(rows, "run").select("k", F.col("night").cast("long").alias("night"))


@query(f"{L}, {SEG.format(gap=20, src='l')}, g AS (SELECT series_id, segment, min(t) AS a, max(t) AS b, count(*) AS n FROM seg GROUP BY ALL) SELECT series_id, max(b) - min(a) AS t_full, coalesce(max(b - a) FILTER (n >= 2), max(b) - min(a)) AS t_chunk FROM g GROUP BY 1")
def longest_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return S.longest_chunk(lines(spark, sf), 20.0)


@query(f"{E} SELECT series_id, round(max(t) - min(t), 6) AS t_full FROM e GROUP BY 1")
def full_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events(spark, sf).groupBy("series_id").agg((F.max("t") - F.min("t")).alias("t_full")), 6)


STEP = "d AS (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY t, k) AS dy FROM {src})"


@query(f"{E}, {STEP.format(src='e')} SELECT series_id, round(CASE WHEN count(y) >= 10 THEN stddev_pop(dy) END, 6) AS hf FROM d GROUP BY 1")
def hf_metric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.step_noise(events(spark, sf)), 6)


@query(f"{L}, {STEP.format(src='l')}, v AS (SELECT *, abs(dy - median(dy) OVER (PARTITION BY series_id)) AS dev FROM d) SELECT series_id, round(CASE WHEN count(y) >= 5 THEN (CASE WHEN median(dev) > 0 THEN median(dev) / CAST(0.6745 AS DOUBLE) ELSE stddev_pop(dy) END) / sqrt(2) END, 4) AS sigma FROM v GROUP BY 1")
def diff_noise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.robust_step_noise(lines(spark, sf)), 4)


@query(f"{E} SELECT k, round(t - median(t) OVER (PARTITION BY series_id), 6) AS t_mid FROM e")
def center_time(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events(spark, sf).select("k", (F.col("t") - F.median("t").over(S.by())).alias("t_mid")), 6)


@query(f"{E}, n AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM e WINDOW w AS (PARTITION BY series_id ORDER BY k)) SELECT series_id, k, y FROM n WHERE y > a AND y > b")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return S.local_maxima(events(spark, sf).select("series_id", "k", "y"), "y", "k")


@query(f"{L}, {SEG.format(gap=20, src='l')}, m AS (SELECT k, y, median(y) OVER (PARTITION BY series_id, segment) AS m FROM seg) SELECT k, round(CASE WHEN m <> 0 THEN y / m ELSE y END, 6) AS level FROM m")
def segment_leveling(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.gap_segments(lines(spark, sf), 20.0).select("k", S.level("y", "series_id", "segment").alias("level")), 6)


@query(f"{E} SELECT k, round(y - avg(y) OVER (PARTITION BY series_id, floor(t)), 6) AS y_nm FROM e")
def night_mean_subtract(spark: SparkSession, sf: str) -> DataFrame:
    nights = events(spark, sf).withColumn("night", F.floor("t"))
    return rounded(nights.select("k", (F.col("y") - F.avg("y").over(S.by("series_id", "night"))).alias("y_nm")), 6)


@query(f"{L} SELECT series_id, round(1e6 * stddev_pop(y), 0) AS rms FROM l GROUP BY 1")
def rms_ppm(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lines(spark, sf).groupBy("series_id").agg(S.rms_ppm("y").alias("rms")), 0)


@query(f"{L} SELECT series_id, round(CASE WHEN count(y) >= 10 THEN quantile_cont(y, 0.99) - quantile_cont(y, 0.01) END, 4) AS amp FROM l GROUP BY 1")
def amp_metric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lines(spark, sf).groupBy("series_id").agg(S.amplitude_metric().alias("amp")), 4)


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y) AS r, greatest(1, floor(0.9e0 * count(*) OVER (PARTITION BY series_id))) AS n FROM e) SELECT series_id, round(median(y), 6) AS trimmed FROM r WHERE r <= n GROUP BY 1")
def trimmed_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.trimmed_median(events(spark, sf), "y", 0.1), 6)


@query(f"{L}, v AS (SELECT series_id, abs(y - median(y) OVER (PARTITION BY series_id)) AS dev FROM l) SELECT series_id, round(median(dev), 4) AS mad, round(1.4826e0 * median(dev), 4) AS sigma FROM v GROUP BY 1")
def mad_sigma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.robust_sigma(lines(spark, sf)), 4)


PHASE = "p AS (SELECT *, (t * 1.7e0) - floor(t * 1.7e0) AS phase FROM e)"


@query(f"{E}, {PHASE} SELECT series_id, CAST(floor(phase / 0.05e0) AS BIGINT) AS bin, round(avg(y), 6) AS mean, count(y) AS n FROM p GROUP BY 1, 2 HAVING count(y) >= 3")
def phase_bin_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.phase_bin_means(events(spark, sf), waves.fold(F.col("t"), F.lit(1.7)), 0.05, 3), 6)


@query(f"{E}, {PHASE} SELECT series_id, CAST(least(floor(phase * 25), 24) AS BIGINT) AS bin, round(median(y), 6) AS median, count(y) AS n FROM p GROUP BY 1, 2")
def phase_bin_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.phase_bin_medians(events(spark, sf), waves.fold(F.col("t"), F.lit(1.7)), 25), 6)


@query(f"{E} SELECT k, round((t - 3) * 0.9e0 - floor((t - 3) * 0.9e0), 6) AS phase FROM e")
def phase_fold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events(spark, sf).select("k", waves.fold(F.col("t"), F.lit(0.9), 3.0).alias("phase")), 6)


@query(f"{E} SELECT k, round(atan2(sin(y), cos(y)), 6) AS phi FROM e")
def phase_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events(spark, sf).select("k", waves.wrapped(F.col("y")).alias("phi")), 6)


@query(f"{L} SELECT k, round(x * sin(2 * pi() * 0.3e0 * t) + x2 * cos(2 * pi() * 0.3e0 * t), 6) + 0 AS wave FROM l")
def sinusoid_eval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lines(spark, sf).select("k", waves.sinusoid(F.col("t"), F.lit(0.3), F.col("x"), F.col("x2")).alias("wave")), 6)


@query(f"{L} SELECT k, round(sqrt(x * x + x2 * x2), 6) AS amp, round(CASE WHEN x = 0 AND x2 = 0 THEN 0 ELSE atan2(x2, x) END, 6) AS phase FROM l")
def amp_phase(spark: SparkSession, sf: str) -> DataFrame:
    s, c = F.col("x"), F.col("x2")
    return rounded(lines(spark, sf).select("k", waves.amplitude(s, c).alias("amp"), waves.phase(s, c).alias("phase")), 6)


@query(f"""{L}, g AS (SELECT *, sqrt(x * x + x2 * x2) AS a, 0.01e0 + x AS ss, 0.02e0 AS sc, 0.03e0 + x2 AS cc FROM l),
h AS (SELECT *, CASE WHEN a > 0 THEN x / a ELSE 1 / sqrt(2) END AS ga, CASE WHEN a > 0 THEN x2 / a ELSE 1 / sqrt(2) END AS gb FROM g)
SELECT k, round(sqrt(ga * ga * ss + 2 * ga * gb * sc + gb * gb * cc), 6) AS amp_err,
round(CASE WHEN a > 0 AND (x2 * x2 * ss - 2 * x * x2 * sc + x * x * cc) >= 0 THEN sqrt(x2 * x2 * ss - 2 * x * x2 * sc + x * x * cc) / (a * a) END, 5) AS phase_err FROM h""")
def amp_phase_errors(spark: SparkSession, sf: str) -> DataFrame:
    s, c, ss, sc, cc = F.col("x"), F.col("x2"), F.lit(0.01) + F.col("x"), F.lit(0.02), F.lit(0.03) + F.col("x2")
    out = lines(spark, sf).select("k", waves.amplitude_error(s, c, ss, sc, cc).alias("amp_err"), waves.phase_error(s, c, ss, sc, cc).alias("phase_err"))
    return rounded(rounded(out, 6, "amp_err"), 5, "phase_err")


@query(f"{L} SELECT k, CASE WHEN x > 0 THEN 1 / x END AS period FROM l")
def period_columns(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("k", waves.period(F.col("x")).alias("period"))


@query(f"{L} SELECT k, round(exp((2 * ln(greatest(x, 1e-30)) + ln(greatest(x2, 1e-30))) / 3), 6) AS power FROM l")
def combine_whitened(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lines(spark, sf).select("k", waves.combined_power(F.col("x"), F.col("x2"), 2.0, 1.0).alias("power")), 6)


@query(f"{L} SELECT k, CASE WHEN x > 0 THEN 1 / (x * x) ELSE 0 END AS weight FROM l")
def signal_weights(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("k", waves.signal_weight(F.col("x")).alias("weight"))


@query(f"{L} SELECT k, round(y / median(y) OVER (PARTITION BY series_id), 6) AS scaled FROM l")
def median_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lines(spark, sf).select("k", S.level("y").alias("scaled")), 6)


@query(f"{E}, f AS (SELECT series_id, min(t) AS first FROM e GROUP BY 1) SELECT series_id, i AS mode, round(atan2(sin(0.3e0 * i + 2 * pi() * i * first), cos(0.3e0 * i + 2 * pi() * i * first)), 5) AS phase FROM f, range(1, 6) r(i)")
def phase_reference_shift(spark: SparkSession, sf: str) -> DataFrame:
    first = events(spark, sf).groupBy("series_id").agg(F.min("t").alias("first"))
    modes = first.withColumn("mode", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    shifted = waves.wrapped(0.3 * F.col("mode") + waves.TAU * F.col("mode") * F.col("first"))
    return rounded(modes.select("series_id", "mode", shifted.alias("phase")), 5)


@query(f"{E}, a AS (SELECT series_id, avg(y) AS s, stddev_pop(y) AS c FROM e GROUP BY 1) SELECT series_id, i AS step, round(s * sin(2 * pi() * (i / 40e0)) + c * cos(2 * pi() * (i / 40e0)), 5) AS model FROM a, range(0, 41) r(i)")
def phase_model_grid(spark: SparkSession, sf: str) -> DataFrame:
    fits = events(spark, sf).groupBy("series_id").agg(F.avg("y").alias("s"), F.stddev_pop("y").alias("c"))
    grid = fits.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))))
    return rounded(grid.select("series_id", "step", waves.sinusoid(F.col("step") / 40.0, F.lit(1.0), F.col("s"), F.col("c")).alias("model")), 5)


@query(f"{L} SELECT k, x >= 0.05 AS detected, CASE WHEN x >= 0.05 THEN y END AS f_local, CASE WHEN x2 < 0.02 THEN 'below_minimum_frequency' END AS skip_reason FROM l")
def snr_accept(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("x") >= 0.05
    return lines(spark, sf).select("k", ok.alias("detected"), F.when(ok, F.col("y")).alias("f_local"), F.when(F.col("x2") < 0.02, "below_minimum_frequency").alias("skip_reason"))


@query(f"{L}, c AS (SELECT * FROM l WHERE x > 0.03 AND x2 > 0.03) SELECT series_id, arg_max(k, (x * x2, -k)) AS k FROM c GROUP BY 1")
def whitened_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    both = lines(spark, sf).filter((F.col("x") > 0.03) & (F.col("x2") > 0.03))
    return both.groupBy("series_id").agg(F.max_by("k", F.struct(F.col("x") * F.col("x2"), -F.col("k"))).alias("k"))


@query(f"{E}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y DESC, k) AS r FROM e) SELECT series_id, r AS rank, k FROM r WHERE r <= 10")
def top_modes(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(S.by().orderBy(F.desc("y"), "k"))
    return events(spark, sf).withColumn("rank", rank).filter(F.col("rank") <= 10).select("series_id", F.col("rank").cast("long").alias("rank"), "k")


@query("SELECT CAST(l_orderkey AS BIGINT) AS k, l_extendedprice AS y, CAST(NULL AS VARCHAR) AS priority FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def mixed_schema_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("y"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("y"), F.col("o_orderpriority").alias("priority"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_orderkey AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).join(done, "k", "left_anti")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def orbit_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Dimension rows are left-joined; what has none stays with nulls (25 nations and 5 regions, whatever the scale)."""
    n = table(spark, sf, "nation").filter("n_nationkey % 2 = 0")
    out = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return out.join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query(f"{L}, a AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t, k, y) AS i, y FROM l), b AS (SELECT l_suppkey AS series_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_tax) AS i, l_tax AS z FROM lineitem WHERE l_returnflag = 'A') SELECT series_id, i, y, z FROM a JOIN b USING (series_id, i)")
def zip_truncate(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda *o: F.row_number().over(S.by().orderBy(*o)).cast("long").alias("i")
    a = lines(spark, sf).select("series_id", number("t", "k", "y"), "y")
    b = lines(spark, sf).filter("run = 'A'").select("series_id", number("k", "x2"), F.col("x2").alias("z"))
    return a.join(b, ["series_id", "i"])
