"""Operators against numpy on synthetic series and small stamps."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.functions import text as X
from lightloom.operators import apertures, modes, pixels, regress, series, spectrum, spline
from lightloom.plans import spectra


def make_series(spark, **many):
    rows = [(name, float(t), float(y), k) for name, (ts, ys) in many.items() for k, (t, y) in enumerate(zip(ts, ys, strict=True))]
    return spark.createDataFrame(rows, "series_id string, t double, y double, k long")


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(4)
    t = np.sort(np.r_[rng.uniform(0, 13, 400), rng.uniform(14, 27, 400)])
    return t, 5 + 2.0 * np.sin(2 * np.pi * 1.3 * t + 0.4) + 1.0 * np.sin(2 * np.pi * 2.9 * t) + rng.normal(0, 0.1, len(t))


def test_gap_at_the_limit_joins(spark):
    t = [0.0, 0.5, 1.0, 1.51, 1.6]
    got = series.gap_segments(make_series(spark, a=(t, t)), 0.5).orderBy("t").collect()
    assert [r.segment for r in got] == [0, 0, 0, 1, 1]


def test_degenerate_series(spark):
    s = make_series(spark, one=([1.0], [2.0]), flat=(range(12), [3.0] * 12), zero=(range(12), [0.0] * 12))
    assert {r.series_id: r.hf for r in series.step_noise(s).collect()} == {"one": None, "flat": 0.0, "zero": 0.0}
    level = s.select("series_id", series.level().alias("v")).groupBy("series_id").agg(F.max("v").alias("v"))
    assert {r.series_id: r.v for r in level.collect()} == {"one": 1.0, "flat": 1.0, "zero": 0.0}
    assert series.longest_chunk(s.filter("false")).count() == 0


def test_nan_becomes_null(spark):
    s = make_series(spark, a=([0.0, 1.0, 2.0, float("inf")], [1.0, float("nan"), 3.0, 4.0]))
    assert [r.y for r in series.clean(s).orderBy("t").collect()] == [1.0, 3.0]


def test_floating_mean_periodogram_equals_least_squares(spark, waves):
    t, y = waves
    s = make_series(spark, a=(t[:150], y[:150]))
    grid = spark.createDataFrame([("a", j, 0.3 + 0.21 * j) for j in range(12)], "series_id string, j long, f double")
    for r in spectrum.lomb_scargle(s, grid).collect():
        a = np.c_[np.ones(150), np.sin(2 * np.pi * r.f * t[:150]), np.cos(2 * np.pi * r.f * t[:150])]
        rss = np.linalg.lstsq(a, y[:150], rcond=None)[1][0]
        assert np.isclose(r.power, (((y[:150] - y[:150].mean()) ** 2).sum() - rss) / 2)


@pytest.mark.parametrize("slopes", [False, True])
def test_night_baseline_equals_dummy_regression(spark, waves, slopes):
    t, y = waves
    night = np.floor(t / 3).astype(int)
    s = make_series(spark, a=(t, y)).withColumn("night", F.floor(F.col("t") / 3))
    grid = spark.createDataFrame([("a", j, 0.4 + 0.3 * j) for j in range(6)], "series_id string, j long, f double")
    base = np.stack([night == n for n in np.unique(night)], 1).astype(float)
    if slopes:
        base = np.c_[base, base * t[:, None]]
    rss = lambda a: ((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum()
    for r in spectrum.nuisance_periodogram(s, grid, "night", slopes).collect():
        full = np.c_[base, np.sin(2 * np.pi * r.f * t), np.cos(2 * np.pi * r.f * t)]
        assert np.isclose(r.power, (rss(base) - rss(full)) / rss(base), atol=1e-9)


def test_sequential_modes_find_both_waves(spark, waves):
    t, y = waves
    flat = 0.1 * np.random.default_rng(0).normal(size=len(t))
    found = modes.sequential_modes(make_series(spark, a=(t, y), b=(t, flat)), 0.2, 5.0, rounds=5, snr_stop=4.0, most=600, steps=41).collect()
    got = {(r.series_id, r.mode): r for r in found}
    assert abs(got["a", 1].f - 1.3) < 1 / 27 and abs(got["a", 1].amp - 2) < 0.05
    assert abs(got["a", 2].f - 2.9) < 1 / 27 and abs(got["a", 2].amp - 1) < 0.05
    assert sum(r.amp > 0.1 for r in found) == 2


def test_whole_searches_have_no_gaps_in_their_grids(spark, waves, monkeypatch):
    """A wave between the points of the thinned grid, and one beyond 2 cycles a day, are found at their frequency."""
    t, _ = waves
    rows = make_series(spark, a=(t, np.sin(2 * np.pi * 1.113 * t)), b=(t, np.sin(2 * np.pi * 7.37 * t)))
    monkeypatch.setattr(spectra, "events", lambda spark, sf: rows)
    power = spectrum.strongest(spectra.multiharmonic_ls(spark, "").filter("f > 0.9")).collect()
    fits = spectrum.with_errors(spectrum.nuisance_periodogram(rows, spectra._grid(rows)))
    tall = {r.series_id: r.f for r in spectrum.strongest(fits, "power").collect()}
    assert abs(tall["a"] - 1.113) < 0.3 / 27 and abs(tall["b"] - 7.37) < 0.3 / 27
    assert all(r.power > 0.95 for r in power)
    left = {r.k: r.y for r in spectra.harmonic_prewhiten(spark, "").filter("k >= 0").collect()}
    assert np.std(list(left.values())) < 0.3


def test_fit_window_is_three_resolutions_twice(spark, waves, monkeypatch):
    t, y = waves
    reach = []
    fit = modes.frequency_fit
    monkeypatch.setattr(modes, "frequency_fit", lambda s, at, half, *a, **k: reach.append(at.select((half * F.col("t_full")).alias("x")).first()[0]) or fit(s, at, half, *a, **k))
    modes.sequential_modes(make_series(spark, a=(t, y)), 0.2, 5.0, rounds=1, most=100, steps=11, kfit=3.0).collect()
    assert np.allclose(reach, 6.0)


def test_joint_extraction_has_every_type(spark, monkeypatch):
    """Both series have every event type; searches keep the reference rounds and steps."""
    rows = make_series(spark, error=([0.0, 1.0], [1.0, 2.0]), signup=([0.0, 2.0], [1.0, 2.0]), other=([0.0, 2.0], [1.0, 1.0])).withColumn("user_id", F.lit(3).cast("long"))
    monkeypatch.setattr(spectra, "events", lambda spark, sf: rows)
    seen = []
    told = []
    whole = {name: inspect.signature(getattr(modes, name)) for name in ("sequential_modes", "joint_modes")}

    def tell(name, *a, **k):
        bound = whole[name].bind(*a, **k)
        bound.apply_defaults()
        told.append(bound.arguments)

    monkeypatch.setattr(modes, "joint_modes", lambda *a, **k: (seen.append(a[:2]), tell("joint_modes", *a, **k), a[0])[-1])
    monkeypatch.setattr(modes, "sequential_modes", lambda *a, **k: (tell("sequential_modes", *a, **k), a[0])[-1])
    spectra.sequential_modes(spark, "")
    spectra.joint_extraction(spark, "")
    first, second = ({r.series_id for r in s.collect()} for s in seen[0])
    assert [(k["kfit"], k["rounds"], k["steps"]) for k in told] == [(3.0, 20, 1001), (3.0, 20, 2001)]
    assert first == second == {"error", "signup", "other"} and seen[0][0].count() + seen[0][1].count() == rows.count()


def test_one_series_alone_equals_a_batch(spark, waves):
    t, y = waves
    grid = lambda *names: spark.createDataFrame([(n, j, 0.5 + 0.1 * j) for n in names for j in range(20)], "series_id string, j long, f double")
    alone = spectrum.lomb_scargle(make_series(spark, a=(t, y)), grid("a")).orderBy("j").collect()
    batch = spectrum.lomb_scargle(make_series(spark, a=(t, y), b=(t, -y)), grid("a", "b")).filter("series_id = 'a'").orderBy("j").collect()
    assert np.allclose([r.power for r in alone], [r.power for r in batch])


def test_prominence_and_spacing(spark):
    y = [0, 3, 1, 2, 0, 5, 4.5, 4.8, 0.0]
    spec = spark.createDataFrame([("a", j, float(j), float(v)) for j, v in enumerate(y)], "series_id string, j long, f double, power double")
    got = {r.j: r.prominence for r in spectrum.prominences(spec).collect()}
    assert np.allclose([got[k] for k in (1, 3, 5, 7)], [3, 1, 5, 0.3])
    assert sorted(r.j for r in spectrum.top_peaks(spec, 5, 3.0, 0.5).collect()) == [1, 5]


def test_huber_resists_outliers(spark):
    rng = np.random.default_rng(1)
    t = np.arange(200.0)
    y = 3 + 0.5 * t + rng.normal(0, 0.1, 200)
    y[::20] += 80
    rows, names = regress.poly_features(make_series(spark, a=(t, y)), 1)
    beta = regress.robust_fit(rows, names, "y", 10).first().beta
    slope = beta[1] / (t[-1] / 2)
    assert abs(slope - 0.5) < 0.01
    plain = regress.least_squares(rows, names, "y").first()
    want = np.linalg.lstsq(np.c_[np.ones(200), (t - t.mean()) / (t[-1] / 2)], y, rcond=None)[0]
    assert np.allclose(plain.beta, want)


def test_rank_deficient_fit_is_the_least_norm(spark):
    s = make_series(spark, a=(range(10), range(10))).withColumn("x1", F.col("t")).withColumn("x2", F.col("t"))
    assert np.allclose(regress.least_squares(s, ["x1", "x2"], "y").first().beta, [0.5, 0.5])


def test_pchip_keeps_knots_and_order(spark):
    knots = spark.createDataFrame([("a", x, v) for x, v in ((0.0, 0.0), (1.0, 1.0), (2.0, 1.0), (4.0, 5.0), (5.0, 5.5))], "series_id string, x double, v double")
    at = np.linspace(-0.2, 5.2, 109)
    got = spline.pchip(make_series(spark, a=(at, at)), knots, "t", "series_id").orderBy("t").collect()
    value = {round(r.t, 4): r.trend for r in got}
    assert np.allclose([value[x] for x in (0.0, 1.0, 2.0, 4.0, 5.0)], [0, 1, 1, 5, 5.5])
    assert (np.diff([r.trend for r in got if 0 <= r.t <= 5]) >= -1e-12).all()


def stamp(spark):
    rng = np.random.default_rng(2)
    yy, xx = np.mgrid[:11, :11]
    star = lambda r, c, a: a * np.exp(-0.5 * ((yy - r) ** 2 + (xx - c) ** 2) / 1.2)
    frames = [star(3, 3, 900) * (1 + 0.1 * np.sin(k / 3)) + star(8, 7, 400) + 10 + rng.normal(0, 0.5, (11, 11)) for k in range(40)]
    rows = [("s", k, f.ravel().tolist()) for k, f in enumerate(frames)]
    cubes = spark.createDataFrame(rows, "stamp_id string, cadence long, flux array<double>")
    return pixels.from_cubes(cubes, 11), np.array(frames)


def test_two_stars(spark):
    px, frames = stamp(spark)
    px = px.cache()
    image = pixels.mean_image(px)
    seeds = pixels.peak_seeds(image, 2, 4.0)
    assert [(r.row, r.col) for r in seeds.orderBy("target").collect()] == [(3, 3), (8, 7)]
    owner = {(r.row, r.col): r.owner for r in pixels.nearest_seed(image, seeds).collect()}
    assert owner[0, 0] == 0 and owner[10, 10] == 1
    mask = spark.createDataFrame([("s", 0, r, c) for r in range(1, 6) for c in range(1, 6)], "stamp_id string, target int, row int, col int")
    sums = pixels.aperture_sums(px, mask).orderBy("cadence").collect()
    assert np.allclose([r.flux for r in sums], frames[:, 1:6, 1:6].sum((1, 2)))
    centre = pixels.centroids(px, mask).first()
    assert abs(centre.crow - 3) < 0.05 and abs(centre.ccol - 3) < 0.05
    grown = apertures.grow(px, seeds, pixels.nearest_seed(image, seeds), "single", 5).collect()
    assert {(3, 3)} < {(r.row, r.col) for r in grown if r.target == 0}
    basins = {(r.row, r.col): r.owner for r in apertures.watershed_regions(px, seeds).collect()}
    assert basins[3, 3] == 0 and basins[8, 7] == 1 and basins[3, 4] == 0 and basins[8, 6] == 1
    core = apertures.grow(px, seeds, pixels.nearest_seed(image, seeds), "core", 5)
    assert core.filter("target = 1 and step = 0").select("row", "col").first() == (8, 7)


def test_smoothing_mirrors_edges(spark):
    px, frames = stamp(spark)
    image = frames.mean(0)
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    k /= k.sum()
    padded = np.pad(image, 4, mode="symmetric")
    rows = np.array([np.convolve(r, k, "valid") for r in padded])
    want = np.array([np.convolve(c, k, "valid") for c in rows.T]).T
    got = pixels.smoothed(pixels.mean_image(px)).orderBy("row", "col").collect()
    assert np.allclose([r.value for r in got], want.ravel())


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(X.extractor_token(lit("  ...  "))) == "unknown"
    assert one(X.without_object_prefix(lit("v* alf UMi"))) == "alf_UMi"
    assert one(X.sector_tag(lit(None), lit("abc"))) == "nosector" and one(X.sector_tag(lit(None), lit("x-s0074-y"))) == "s0074"
    assert one(X.base_run_token(lit("a"))) == "a" and one(X.base_run_token(lit("12b"))) == "12"
    assert one(X.header_value(F.create_map(lit("A"), lit(""), lit("B"), lit("v")), "A", "B")) == "v"
