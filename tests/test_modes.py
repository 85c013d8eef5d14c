"""Mode searches and designs on made series, against known truth and numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.operators import apertures, modes, regress, series, spectrum


def frame(spark, curves):
    rows = [(name, float(t), float(y), k) for name, (ts, ys) in curves.items() for k, (t, y) in enumerate(zip(ts, ys, strict=True))]
    return spark.createDataFrame(rows, "series_id string, t double, y double, k long").cache()


@pytest.fixture(scope="module")
def curves():
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 25, 500))
    wave = lambda f, a, p: a * np.sin(2 * np.pi * f * t + p)
    one = wave(1.31, 2.0, 0.3) + wave(1.31 + 7 / 25, 1.2, 1.0) + 0.2 * rng.normal(size=500)
    two = wave(2.2, 1.5, 0.1) + 0.2 * rng.normal(size=500)
    return {"one": (t, one), "two": (t, two)}


def test_wave_sums(spark, curves):
    s = frame(spark, curves)
    grid = spectrum.frequency_grid(series.longest_chunk(s), 0.2, 12.0)
    got = {(r.series_id, r.j): r for r in spectrum.wave_sums(s, grid).collect()}
    for name, (t, y) in curves.items():
        for j in (0, 57, 280):
            r = got[name, j]
            sin, cos = np.sin(2 * np.pi * r.f * t), np.cos(2 * np.pi * r.f * t)
            want = (len(t), y.sum(), sin.sum(), cos.sum(), (sin * sin).sum(), (cos * cos).sum(), (sin * cos).sum(), (y * sin).sum(), (y * cos).sum())
            assert np.allclose((r.n0, r.sy, r.ss, r.sc, r.sss, r.scc, r.ssc, r.sys, r.syc), want)


def test_multiharmonic_power(spark, curves):
    s = frame(spark, curves)
    grid = spectrum.frequency_grid(series.longest_chunk(s), 0.2, 4.0)
    t, y = curves["one"]
    for r in modes.multiharmonic_power(s, grid, 3).filter("series_id = 'one' and j % 20 = 3").collect():
        x = np.column_stack([np.ones(len(t)), *[w(2 * np.pi * h * r.f * t) for h in (1, 2, 3) for w in (np.sin, np.cos)]])
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.isclose(r.power, 1 - (left @ left) / ((y - y.mean()) @ (y - y.mean())), atol=1e-8)


def test_sequential_modes(spark, curves):
    """Two modes 7 / T apart are both found; what is left beside a found mode is not found again."""
    got = {}
    for r in modes.sequential_modes(frame(spark, curves), 0.2, 6.0, rounds=4).collect():
        got.setdefault(r.series_id, []).append((r.f, r.amp))
    assert np.allclose(got["one"][:2], [(1.31, 2.0), (1.59, 1.2)], atol=0.08) and np.allclose(got["two"][0], (2.2, 1.5), atol=0.05)
    for found in got.values():
        f = np.sort([x for x, _ in found])
        assert (np.diff(f) > 0.75 * modes.SEPARATION / 25).all()  # a fit may move a little into the neighbourhood


def test_guided_search(spark, curves):
    s = frame(spark, curves)
    templates = spark.createDataFrame([(n, k, f) for n in curves for k, f in enumerate((0.05, 1.3, 1.6, 2.21, 5.0), 1)], "series_id string, mode int, f_template double")
    spans = series.longest_chunk(s)
    rows, _ = modes.guided_rows(s, templates, spans, half_bins=3.0, snr_min=5.0)
    by = {(r.series_id, r.mode): r for r in rows.collect()}
    assert by["one", 1].skip_reason == "below_minimum_frequency" and by["one", 5].skip_reason == "snr_below_threshold"
    got = {(r.series_id, r.mode): (r.f, r.amp) for r in modes.guided_search(s, templates, spans, half_bins=3.0, snr_min=5.0).collect()}
    assert set(got) == {("one", 2), ("one", 3), ("two", 4)}
    assert np.allclose(got["one", 2], (1.31, 2.0), atol=0.05) and np.allclose(got["one", 3], (1.59, 1.2), atol=0.05) and np.allclose(got["two", 4], (2.2, 1.5), atol=0.05)


def test_harmonic_prewhitening(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 12, 300))
    y = 3 + np.sin(2 * np.pi * 0.817 * t) + 0.5 * np.cos(4 * np.pi * 0.817 * t) + 0.01 * rng.normal(size=300)
    s = frame(spark, {"a": (t, y)})
    grid = spectrum.frequency_grid(series.longest_chunk(s), 0.1, 3.0, oversample=60.0)
    left = np.array([r.y for r in modes.harmonic_prewhitened(s, grid, rounds=1, harmonics=2, stop=-100.0).collect()])
    assert left.std() < 0.02


def test_wide_designs(spark, curves):
    s = frame(spark, curves)
    rows, names = regress.hinge_features(s, ["t"], spacing=1.0)
    assert len(names) == 2 + 24  # a knot a day, none is dropped
    t, y = curves["two"]
    x = np.column_stack([np.ones(len(t)), t - np.median(t), *[np.maximum(0, t - (t[0] + k)) * (t[0] + k < t[-1]) for k in range(1, 25)]])
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r.series_id: r.rss for r in regress.least_squares(rows, names, "y").collect()}
    assert np.isclose(got["two"], want @ want, rtol=1e-6)


def test_background_scale_and_split(spark):
    rng = np.random.default_rng(7)
    b = 5 + np.cumsum(rng.normal(size=400)) * 0.1
    y = 100 + 3.0 * b + 0.05 * rng.normal(size=400)
    df = spark.createDataFrame([("a", float(k), float(y[k]), float(b[k]), k) for k in range(400)], "series_id string, t double, y double, b double, k long")
    got = regress.background_scale(df, "b").first().k
    ks = np.arange(200) * (2 * np.median(y) / np.median(b)) / 199
    noise = [np.std(np.diff(y - k * b)) / abs(np.median(y - k * b)) for k in ks]
    assert np.isclose(got, ks[int(np.argmin(noise))])
    few = df.withColumns({"half": F.col("t") >= 350, "x": F.rand(1), "x2": F.rand(2)})
    out = {r.k: r for r in regress.split_decorrelated(few, "x", "x2", "b", "half").collect()}
    assert out[380].decorrelated == out[380].y and out[10].decorrelated != out[10].y  # 50 points are too few


def test_growth_with_a_negative_pixel(spark):
    """Noise is never negative: the quiet pixel is taken before the noisy negative one."""
    rng = np.random.default_rng(2)
    curves = {(0, 0): 1000 + rng.normal(size=200), (0, 1): 100 + 0.1 * rng.normal(size=200), (1, 0): -250 + 30 * rng.normal(size=200)}
    assert apertures._noise(curves[1, 0]) > 0
    assert apertures._grow(curves, [(0, 0)], set(curves), 2, 0.0)[:2] == [(0, 0), (0, 1)]


def test_joint_modes(spark, curves):
    """With nights and errors; what it tells at the pick, errors of both fits, and weights of the data sets."""
    t, y = curves["two"]
    rng = np.random.default_rng(9)
    err = rng.uniform(0.05, 0.2, len(t))
    other = 0.7 * np.cos(2 * np.pi * 2.2 * t) + 0.5 * np.floor(t) + err * rng.normal(size=len(t))
    rows = [("two", float(a), float(b), float(e), int(a), k) for k, (a, b, e) in enumerate(zip(t, other, err, strict=True))]
    second = spectrum.with_weights(spark.createDataFrame(rows, "series_id string, t double, y double, yerr double, night int, k long"))
    b = spectrum.Baseline("night", weight="weight")
    rows = modes.joint_modes(frame(spark, {"two": (t, y)}), second, 0.5, 5.0, b, rounds=2, mode="sqrt").collect()
    r = min(rows, key=lambda r: r.n)
    assert abs(r.f_first - 2.2) < 0.01 and abs(r.f_second - 2.2) < 0.01 and abs(r.amp_second - 0.7) < 4 * r.amp_err_second
    assert 0 < r.amp_err_first < 0.05 and 0 < r.phase_err_second < 0.1 and min(r.w_first_at_pick, r.w_second_at_pick) > 1.5
    assert (r.n_groups, r.offsets, r.slopes) == (len(np.unique(np.floor(t))), True, False) and r.snr_second > 2
    none = modes.joint_modes(frame(spark, {"two": (t, y)}), second, 0.5, 5.0, b, rounds=1, prefilter=1e9)
    assert none.count() == 0 and none.columns == list(r.__fields__)


def test_guided_channels_from_photometric_modes(spark, curves):
    """From the photometry's own modes to three channels of each target, whose resolution is another."""
    photo = modes.photometric_modes(frame(spark, curves), 0.2, 6.0, rounds=4, steps=201)
    own = {(r.series_id, round(r.f, 1)): r.resolution for r in photo.collect()}
    t = curves["one"][0]
    assert {("one", 1.3), ("one", 1.6), ("two", 2.2)} <= set(own) and np.allclose(list(own.values()), 1 / (t[-1] - t[0]))
    rng = np.random.default_rng(12)
    late = np.sort(rng.uniform(0, 10, 400))
    wave = lambda f: np.sin(2 * np.pi * f * late)
    made = {("one", "q"): wave(1.31), ("one", "u"): wave(1.59), ("one", "p"): 0 * late, ("two", "q"): 0 * late, ("two", "u"): 2 * wave(2.2), ("two", "p"): wave(2.2)}
    rows = [(a, c, float(x), float(v + 0.3 * np.floor(x) + 0.1 * rng.normal()), int(x), k) for (a, c), y in made.items() for k, (x, v) in enumerate(zip(late, y, strict=True))]
    channels = spark.createDataFrame(rows, "target string, channel string, t double, y double, night int, k long")
    out = modes.guided_channels(channels, photo, "night", snr_min=6.0, steps=201).collect()
    got = {(r.target, r.channel): (r.f, np.hypot(r.s_coeff, r.c_coeff), r.amp) for r in out}
    assert set(got) == {("one", "q"), ("one", "u"), ("two", "u"), ("two", "p")} and len(out) == 4
    for key, (f, amp) in {("one", "q"): (1.31, 1), ("one", "u"): (1.59, 1), ("two", "u"): (2.2, 2), ("two", "p"): (2.2, 1)}.items():
        assert abs(got[key][0] - f) < 0.02 and abs(got[key][2] - amp) < 0.1 and np.isclose(got[key][1], got[key][2])


def test_a_poisoned_series_stops_no_other(spark, curves):
    """Points that are no numbers, too few points, no span, and a series on which the search itself fails."""
    t, y = curves["two"]
    many = {f"s{k}": (t[:200], y[:200]) for k in range(3)} | {"nan": (t[:100], np.full(100, np.nan)), "few": (t[:9], y[:9]), "once": (np.zeros(70), y[:70]), "some": (np.r_[t[:200], np.inf], np.r_[y[:200], 1.0])}
    s = frame(spark, many)
    templates = s.select("series_id").distinct().withColumns({"mode": F.lit(1), "f_template": F.lit(2.2)})
    poisoned = templates.withColumn("f_template", F.when(F.col("series_id") == "s1", F.raise_error(F.lit("poison")).cast("double")).otherwise(F.col("f_template")))
    got = {r.series_id: r for r in modes.batch_search(s, poisoned, half_bins=3.0, snr_min=3.0, steps=51).collect()}
    assert {n: r.status for n, r in got.items()} == {"s0": "ok", "s1": "failed", "s2": "ok", "nan": "no_values", "few": "too_short", "once": "no_span", "some": "ok"}
    assert "poison" in got["s1"].reason or "Exception" in got["s1"].reason
    assert all(got[n].detected == 1 and abs(got[n].best_f - 2.2) < 0.05 for n in ("s0", "s2", "some")) and got["s1"].detected == 0


@pytest.mark.parametrize("legacy", [True, False])
def test_exhaustive_aperture(spark, legacy):
    """Against a walk over the flattened frames, with and without the older geometry rule."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for stamp, (nrow, ncol, top) in {"a": (5, 4, 4000.0), "b": (4, 6, 50.0), "c": (3, 3, 10.0)}.items():
        level = rng.uniform(-2, top, nrow * ncol)
        cube = level + rng.normal(size=(30, nrow * ncol)) * rng.uniform(0.5, 9, nrow * ncol)
        rows += [(stamp, c, r // ncol, r % ncol, float(cube[c, r])) for c in range(30) for r in range(nrow * ncol)]
        mean = cube.mean(0)
        inside = list(np.flatnonzero(mean > 3000.0)) or [int(mean.argmax())]
        first, best = len(inside), None
        while True:
            total = cube[:, inside].sum(1)
            fom = np.diff(total).std() / total.mean()
            if best is None or fom < best[0]:
                best = (fom, list(inside))
            free = [k for k in range(1, nrow * ncol) if k not in inside and mean[k] > 0]
            if legacy:
                free = [k for k in free if (k + 1) % nrow > 1 and (k + 1) % ncol < 20 and k != 18]
            if not free:
                break
            trial = {k: np.abs(np.diff(total + cube[:, k])).sum() / (total + cube[:, k]).sum() for k in free}
            inside.append(min(free, key=trial.get))
        want[stamp] = (best[0], {(k // ncol, k % ncol) for k in best[1]}, (nrow, ncol, nrow * ncol, 30, first, len(best[1])))
    rows += [("short", c, 0, 0, 1.0) for c in range(2)]
    px = spark.createDataFrame(rows, "stamp_id string, cadence long, row int, col int, flux double")
    mask, figures = apertures.exhaustive_aperture(px, legacy=legacy)
    got = {}
    for r in mask.collect():
        got.setdefault(r.stamp_id, set()).add((r.row, r.col))
    assert got == {s: w[1] for s, w in want.items()}
    for r in figures.collect():
        fom, _, told = want[r.stamp_id]
        assert np.isclose(r.best_fom, fom) and tuple(r)[1:7] == told and tuple(r)[8:] == (3000.0, min(20, told[2]), legacy)
    assert figures.count() == 3
