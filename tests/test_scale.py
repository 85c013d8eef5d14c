"""Steps whose time or memory grew faster than the tables."""

import numpy as np
from pyspark.sql import functions as F

from lightloom.operators import modes as M
from lightloom.operators import regress as R
from lightloom.operators import spectrum as P
from lightloom.plans.registry import rounded


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_transform_equals_products():
    """Many samples are transformed: the same sums as by products, harmonics, late times and high local grids too."""
    rng = np.random.default_rng(5)
    for low, step, n, zero in ((0.01, 0.011, 1500, 0.0), (49.9, 1e-4, 1001, 2450000.0), (0.3, 0.0, 1, 7.0)):
        t, weights = zero + rng.uniform(0, 30, 5000), rng.normal(size=(3, 5000))
        wanted = [(0, 1), (1, 1), (2, 3)]
        ours, plain = (f(t, weights, low, step, n, wanted) for f in (P._wave_transform, P._wave_products))
        f = low + step * np.arange(n)
        exact = np.stack([(weights[k][None, :] * np.exp(2j * np.pi * m * np.outer(f, t))).sum(1) for k, m in wanted])
        assert np.abs(ours - exact).max() < (1e-4 if zero > 1e6 else 1e-8) and np.abs(plain - exact).max() < (1e-4 if zero > 1e6 else 1e-8)


def test_small_series_shuffle_no_frequencies(spark, monkeypatch):
    """Sums of small series are whole in one task; those of long ones are added from all tasks: the same either way."""
    series = spark.range(600).select((F.col("id") % 6).alias("series_id"), (F.col("id") * 0.01).alias("t"), F.sin(F.col("id") * 0.3).alias("y"))
    grid = spark.range(50).select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(6)])).alias("series_id"), F.col("id").alias("j"), (0.1 + 0.05 * F.col("id")).alias("f"))
    whole = {(r.series_id, r.j): r for r in P.wave_sums(series, grid).collect()}
    assert len(whole) == 300 and "RepartitionByExpression [series_id" in _plan(P.wave_sums(series, grid))
    monkeypatch.setattr(P, "WHOLE", 0)
    added = P.wave_sums(series, grid).collect()
    assert len(added) == 300
    for r in added:
        assert all(abs(a - b) < 1e-9 for a, b in zip(r[1:], whole[r.series_id, r.j][1:], strict=True))


def test_robust_fit_of_small_series_equals_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(x), float(2 + s * x + rng.normal() + (40 if i % 9 == 0 else 0))) for s in range(4) for i, x in enumerate(rng.normal(size=120))]
    rows += [(9, 1.0, 5.0)] * 10  # a MAD of 0
    df = spark.createDataFrame(rows, "series_id long, x double, y double").withColumn("one", F.lit(1.0))
    for stop in (False, True):
        fits = R.robust_fit(df, ["one", "x"], "y", stop=stop)
        assert "sum(" not in _plan(fits)  # all rounds in one task a series
        ours = {r.series_id: r.beta for r in fits.collect()}
        rounds = {r.series_id: r.beta for r in R._robust_rounds(df, ["one", "x"], "y", 8, ("series_id",), stop).collect()}
        assert ours.keys() == rounds.keys() and all(np.allclose(ours[k], rounds[k], atol=1e-9) for k in ours)


def test_background_scale_makes_no_object_of_a_point(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("series_id"), F.col("id").alias("k"), F.col("id").cast("double").alias("t"), (5 + F.col("id") % 7 + 2.0 * (F.col("id") % 5)).alias("y"), (1.0 + F.col("id") % 5).alias("b"))
    out = R.background_scale(df, "b")
    assert "ArrowEvalPython" not in _plan(out) and "struct<y" not in _plan(out) and out.count() == 2


def test_global_refinement_shuffles_no_waves(spark, monkeypatch):
    """Fits of all modes at once: nights, slopes and weights against numpy; long series give the same by parts."""
    rng = np.random.default_rng(11)
    t = np.sort(rng.uniform(0, 6, 300))
    night, w = np.floor(t).astype(int), rng.uniform(0.5, 2, 300)
    y = 3 * np.sin(2 * np.pi * 1.3 * t) + np.cos(2 * np.pi * 2.7 * t) + 5 * night + 2 * (t - night) + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([("a", float(a), float(b), i, int(c), float(d)) for i, (a, b, c, d) in enumerate(zip(t, y, night, w, strict=True))], "series_id string, t double, y double, k long, night long, weight double")
    modes = spark.createDataFrame([("a", 1, 1.3), ("a", 2, 2.7)], "series_id string, mode int, f double")
    columns = [g(2 * np.pi * f * t) for f in (1.3, 2.7) for g in (np.sin, np.cos)] + [(night == n) * x for n in range(6) for x in (np.ones(300), t)]
    root = np.sqrt(w)
    want = np.linalg.lstsq(np.stack(columns, 1) * root[:, None], y * root, rcond=None)[0][:4]
    b = P.Baseline("night", slopes=True, weight="weight")
    for limit in (50_000, 0):
        monkeypatch.setattr(M, "WHOLE", limit)
        got = M._mode_fits(df, modes, 2, False, b).collect()
        assert len(got) == 1 and np.allclose(got[0].beta, want, atol=1e-8)


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [0.06445, -0.06445, 0.00005, 1.00005, 2.5, 0.12345, 1e305, -0.00001, 0.0, None, 1.005, 64.45 * 0.001]
    got = [r.x for r in rounded(spark.createDataFrame([(v,) for v in values], "x double"), 4).collect()]
    want = [r[0] for r in duckdb.sql("SELECT round(x, 4) + 0.0 FROM (SELECT unnest([" + ", ".join("NULL" if v is None else f"{v!r}::DOUBLE" for v in values) + "]) AS x)").fetchall()]
    assert got == want and got[0] == 0.0644


def test_spectra_are_solved_where_the_sums_are(spark, monkeypatch):
    """A fit of many frequencies gives its task's best row, and a row of a sum is never made; long series, by parts, give the same."""
    rng = np.random.default_rng(2)
    rows = [(s, float(t), float(np.sin(2 * np.pi * (0.7 + 0.1 * s) * t) + rng.normal()), i, int(t)) for s in range(3) for i, t in enumerate(rng.uniform(0, 9, 150))]
    df = spark.createDataFrame(rows, "series_id long, t double, y double, k long, night long")
    at = df.select("series_id").distinct().withColumn("f0", 0.7 + 0.1 * F.col("series_id"))
    grid = P.local_grid(at, F.lit(0.3), F.lit(0.01), 0.1, 5.0).select("series_id", "j", "f")
    runs = {}
    for limit in (50_000, 0):
        monkeypatch.setattr(P, "WHOLE", limit)
        fits, power = P.frequency_fit(df, at, F.lit(0.2), 0.1, 5.0, 101, P.Baseline("night", slopes=True)), M.multiharmonic_power(df, grid, 2)
        if limit:
            assert all("posexplode" not in _plan(x) for x in (fits, power, P.lomb_scargle(df, grid)))
        runs[limit] = [sorted(tuple(r) for r in x.collect()) for x in (fits, power, P.lomb_scargle(df, grid), P.harmonic_power(df, grid, 2, best=True))]
    assert [len(x) for x in runs[0]] == [3, grid.count(), grid.count(), 3]
    for a, b in zip(runs[0], runs[50_000], strict=True):
        assert np.allclose(np.array(a, float), np.array(b, float), atol=1e-9)
    best = {r[0]: r for r in runs[0][3]}
    assert all(best[s][3] == max(r[3] for r in runs[0][1] if r[0] == s) for s in range(3))


def test_small_series_are_refined_whole_in_one_task(spark, monkeypatch):
    """All rounds of a refinement in one task a series: the same modes as by rounds of jobs, beside nights with slopes too."""
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 8, 200))
    rows = [(s, float(x), float((2 + s) * np.sin(2 * np.pi * 1.3 * x) + np.cos(2 * np.pi * (2.6 + 0.1 * s) * x) + 0.3 * rng.normal()), i, int(x)) for s in range(3) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "series_id long, t double, y double, k long, night long")
    modes = spark.createDataFrame([(s, m, f) for s in range(3) for m, f in ((1, 1.33), (2, 2.6 + 0.1 * s + 0.03))], "series_id long, mode int, f double")
    spans, b = df.groupBy("series_id").agg((F.max("t") - F.min("t")).alias("t_full")), P.Baseline("night", slopes=True)
    monkeypatch.setattr(M, "SEPARATION", 0.5)
    whole = sorted(tuple(r) for r in M.global_refinement(df, modes, spans, 3, b).collect())
    assert len(whole) == 6 and all(abs(r[2] - f) < 0.02 for r, f in zip(whole, (1.3, 2.6, 1.3, 2.7, 1.3, 2.8), strict=True))
    monkeypatch.setattr(M, "WHOLE", 0)
    assert np.allclose(np.array(sorted(tuple(r) for r in M.global_refinement(df, modes, spans, 3, b).collect())), np.array(whole), atol=1e-8)
    start = modes.withColumns({"low": F.col("f") - 0.2, "high": F.col("f") + 0.2})
    assert "MapInArrow" in _plan(M._refined_whole(df, start, b, 3))


def test_rounds_read_packed_points(spark, monkeypatch):
    """Long series are packed once, passes read the arrays: the same as by rows, beside nights with slopes and weights too."""
    rng = np.random.default_rng(4)
    rows = [(s, float(t), float(5 + 3 * np.sin(2 * np.pi * 1.3 * t) + rng.normal()), i, int(t), float(1 + i % 3)) for s in range(3) for i, t in enumerate(np.sort(rng.uniform(0, 6, 150)))]
    df = spark.createDataFrame([*rows, (0, None, 1.0, 900, 1, 1.0), (1, 2.0, None, 901, 1, 1.0)], "series_id long, t double, y double, k long, night long, weight double")
    at = df.filter("series_id < 2").select("series_id").distinct().withColumn("f0", F.lit(1.3))
    grid = P.local_grid(df.select("series_id").distinct().withColumn("f0", F.lit(1.2)), F.lit(0.5), F.lit(0.05), 0.1, 5.0).select("series_id", "j", "f")
    near = lambda a, b: len(a) == len(b) and all(np.allclose(np.array(x, float), np.array(y, float), atol=1e-8, equal_nan=True) for x, y in zip(sorted(map(tuple, a)), sorted(map(tuple, b)), strict=True))
    for b in (P.Baseline(), P.Baseline("night", slopes=True, weight="weight")):
        fits = P.frequency_fit(df, at, F.lit(0.2), 0.1, 5.0, 51, b).localCheckpoint()
        power = lambda s: P.nuisance_periodogram(s, grid, b).select("series_id", "j", "power").collect()  # noqa: B023, E731
        before, after = power(df), power(P.prewhitened(df, fits, baseline=b))
        for limit in (50_000, 0):
            monkeypatch.setattr(P, "WHOLE", limit)
            samples = P.packed_samples(df, b)
            assert (samples.packed is None) == (limit == 50_000) and (samples.rows is None) == (limit == 0)
            assert near(power(samples), before) and near(power(samples.less(fits)), after)
            assert {r.series_id for r in power(samples.less(fits, only=True))} == {0, 1}
    left, grid = {}, P.frequency_grid(df.groupBy("series_id").agg(F.lit(6.0).alias("t_full")), 0.1, 3.0, oversample=90.0)
    for limit in (50_000, 0):
        monkeypatch.setattr(P, "WHOLE", limit)
        left[limit] = [(r.k, r.y) for r in M.harmonic_prewhitened(df.select("series_id", "t", "y", "k"), grid, 2, 1, -100.0, steps=21).filter("k < 900").collect()]
    assert near(left[0], left[50_000]) and len(left[0]) == 450 and np.std([y for _, y in left[0]]) < 1.1
