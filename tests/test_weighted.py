"""Fits to points with errors, noise windows and prominences against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.operators import modes, series, spectrum

RNG = np.random.default_rng(11)
T = np.sort(np.r_[RNG.uniform(0, 4, 60), RNG.uniform(6, 9, 50), 12.5])
NIGHT = np.floor(T).astype(int)
ERR = RNG.uniform(0.1, 1.5, len(T))
Y = 2 + 0.8 * np.sin(2 * np.pi * 1.7 * T + 0.4) + 0.3 * NIGHT + 0.2 * ERR * RNG.normal(size=len(T))
KINDS = [(False, False, False), (False, False, True), (True, False, True), (True, True, True), (False, True, True), (True, True, False)]


def frame(spark, err=ERR, y=Y):
    rows = [("a", float(t), float(v), float(e), int(n), k) for k, (t, v, e, n) in enumerate(zip(T, y, err, NIGHT, strict=True))]
    return spectrum.with_weights(spark.createDataFrame(rows, "series_id string, t double, y double, yerr double, night int, k long"))


def design(offsets, slopes):
    cols = [(NIGHT == n).astype(float) for n in np.unique(NIGHT)] if offsets else []
    if slopes:
        cols += [np.where(NIGHT == n, T - T[NIGHT == n].mean(), 0.0) for n in np.unique(NIGHT)]
    return np.column_stack(cols or [np.ones(len(T))])


def solve(x, y, w):
    beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    left = y - x @ beta
    rss = float(np.sum(w * left * left))
    cov = np.linalg.pinv((x * w[:, None]).T @ x) * rss / max(np.count_nonzero(w > 0) - x.shape[1], 1)
    return beta, rss, cov, left


def baseline(offsets, slopes, weighted):
    return spectrum.Baseline("night" if offsets or slopes else None, offsets, slopes, "weight" if weighted else None)


def waves(f):
    return np.column_stack([np.sin(2 * np.pi * f * T), np.cos(2 * np.pi * f * T)])


@pytest.mark.parametrize(("offsets", "slopes", "weighted"), KINDS)
def test_periodogram_equals_regression(spark, offsets, slopes, weighted):
    """Block elimination gives the power, fit and covariance of a regression with a column for every night."""
    w = 1 / ERR**2 if weighted else np.ones(len(T))
    grid = spark.createDataFrame([("a", j, 0.3 + 0.37 * j) for j in range(9)], "series_id string, j long, f double")
    base = design(offsets, slopes)
    _, rss0, _, _ = solve(base, Y, w)
    got = spectrum.with_errors(spectrum.nuisance_periodogram(frame(spark), grid, baseline(offsets, slopes, weighted))).collect()
    assert len(got) == 9
    for r in got:
        beta, rss, cov, _ = solve(np.column_stack([waves(r.f), base]), Y, w)
        want = (rss, max(0, (rss0 - rss) / rss0), *beta[:2], cov[0, 0], cov[0, 1], cov[1, 1])
        assert np.allclose((r.rss, r.power, r.s_coeff, r.c_coeff, r.cov_ss, r.cov_sc, r.cov_cc), want, rtol=1e-9, atol=1e-10)
        grad = beta[:2] / np.hypot(*beta[:2])
        assert np.isclose(r.amp_err, np.sqrt(grad @ cov[:2, :2] @ grad))
        turn = np.array([-beta[1], beta[0]]) / (beta[:2] @ beta[:2])
        assert np.isclose(r.phase_err, np.sqrt(turn @ cov[:2, :2] @ turn))


@pytest.mark.parametrize(("offsets", "slopes", "weighted"), KINDS)
def test_fit_and_prewhitening(spark, offsets, slopes, weighted):
    w = 1 / ERR**2 if weighted else np.ones(len(T))
    b, base = baseline(offsets, slopes, weighted), design(offsets, slopes)
    s = frame(spark)
    at = spark.createDataFrame([("a", 1.66)], "series_id string, f0 double")
    fit = spectrum.frequency_fit(s, at, F.lit(0.2), 0.01, 50.0, 101, b)
    freqs = np.linspace(1.46, 1.86, 101)
    best = min(freqs, key=lambda f: solve(np.column_stack([waves(f), base]), Y, w)[1])
    assert np.isclose(fit.first().f, best)
    left = [r.y for r in spectrum.prewhitened(s, fit, baseline=b).orderBy("k").collect()]
    assert np.allclose(left, solve(np.column_stack([waves(best), base]), Y, w)[3], atol=1e-8)
    assert all(r.y == v for r, v in zip(spectrum.prewhitened(s, fit.limit(0), baseline=b).orderBy("k").collect(), Y, strict=True))


def test_range_of_nothing_is_halved(spark):
    at = spark.createDataFrame([("a", 1.7, 1.8, 1.6)], "series_id string, f0 double, low double, high double")
    r = spectrum.frequency_fit(frame(spark), at, F.lit(0.4), 0.01, 50.0, 5, None, ("low", "high")).first()
    assert 1.6 <= r.f <= 1.8  # low is over high: the inner half is tried, with 11 points at least


def test_weights(spark):
    bad = ERR.copy()
    bad[:4] = [0.0, -1.0, np.nan, np.inf]
    got = [r.weight for r in frame(spark, bad).orderBy("k").collect()]
    assert got[:4] == [0, 0, 0, 0] and np.allclose(got[4:], 1 / ERR[4:] ** 2)
    assert {r.weight for r in frame(spark, np.full(len(T), np.nan)).collect()} == {1.0}


def test_weighted_photometry(spark):
    """Lomb-Scargle with errors is half the drop of chi square."""
    w = 1 / ERR**2
    grid = spark.createDataFrame([("a", j, 0.5 + 0.4 * j) for j in range(4)], "series_id string, j long, f double")
    for r in spectrum.lomb_scargle(frame(spark), grid, F.col("weight")).collect():
        one = np.ones((len(T), 1))
        assert np.isclose(r.power, (solve(one, Y, w)[1] - solve(np.column_stack([waves(r.f), one]), Y, w)[1]) / 2)


def trimmed(x, top=0.1):
    x = np.sort(x[np.isfinite(x)])
    return np.median(x[: min(max(int(np.floor((1 - top) * len(x))), 1), len(x))]) if len(x) else np.nan


def floor_at(f, p, f0, t, ks, kfit, bins, outside):
    guard, side = kfit * (2 / t), max(ks * (1 / t), bins * np.median(np.diff(f)))
    m = ((f >= f0 - (guard + side)) & (f <= f0 - guard)) | ((f >= f0 + guard) & (f <= f0 + (guard + side)))
    n = trimmed(p[m])
    if outside and not n > 0:
        n = trimmed(p[np.abs(f - f0) >= guard])
    return n if n > 0 else trimmed(p)


@pytest.mark.parametrize(("n", "t", "ks", "kfit", "bins"), [(400, 19.3, 15.0, 3.0, 30), (150, 2.0, 10.0, 3.0, 30), (60, 9.0, 3.0, 0.5, 2), (300, 40.0, 4.5, 0.0, 1), (30, 0.3, 15.0, 3.0, 6)])
def test_noise_floor(spark, monkeypatch, n, t, ks, kfit, bins):
    """Windows in 1 / T over whole grids, cut into blocks, with missing bins and windows that hold nothing."""
    monkeypatch.setattr(spectrum, "_NOISE_BLOCK", 64)
    f = 0.1 + 0.05 * np.arange(n)
    p = RNG.exponential(size=n)
    p[n // 3 : n // 3 + 5] = 0.0
    rows = [("a", j, float(f[j]), None if j % 17 == 5 else float(p[j])) for j in range(n)] + [("few", j, 1.0 + j, 1.0) for j in range(4)]
    spec = spark.createDataFrame(rows, "series_id string, j long, f double, power double")
    spans = spark.createDataFrame([("a", t), ("few", t)], "series_id string, t_full double")
    holed = np.where(np.arange(n) % 17 == 5, np.nan, p)
    got = {(r.series_id, r.j): r for r in spectrum.whitened(spec, spans, ks=ks, kfit=kfit, side_bins=bins).collect()}
    assert len(got) == n + 4 and all(got["few", j].noise is None and got["few", j].white is None for j in range(4))
    for j in range(n):
        want = floor_at(f, holed, f[j], t, ks, kfit, bins, False)
        assert np.isclose(got["a", j].noise, want, rtol=1e-9)
        assert got["a", j].white is None if np.isnan(holed[j]) else np.isclose(got["a", j].white, holed[j] / want)


@pytest.mark.parametrize("t", [30.0, 2.0, 0.5])
def test_snr_at(spark, t):
    f, p = 0.1 + 0.05 * np.arange(120), RNG.exponential(size=120)
    spec = spark.createDataFrame([("a", j, float(f[j]), float(p[j])) for j in range(120)], "series_id string, j long, f double, power double")
    at = spark.createDataFrame([("a", 3.01, t)], "series_id string, f0 double, t double")
    guard, side = 3.0 * (2.0 / F.col("t")), F.greatest(3.0 * (1.0 / F.col("t")), F.lit(6 * 0.05))
    r = modes.snr_at(spec, at, guard, side).first()
    w = p[np.argmin(np.abs(f - 3.01))] / floor_at(f, p, 3.01, t, 3.0, 3.0, 6, True)
    assert np.isclose(r.w, w) and np.isclose(r.snr, np.sqrt(w))


@pytest.mark.parametrize("nightly", [False, True])
def test_snr_after_fit(spark, nightly):
    """Guard and sides in 1 / T of the whole span; the annulus grows until it has 12 points."""
    s = frame(spark)
    b = spectrum.Baseline("night", weight="weight") if nightly else spectrum.Baseline(weight="weight")
    span = float(T[-1] - T[0])
    fits = spark.createDataFrame([("a", 1.7)], "series_id string, f double")
    got = modes.snr_after_fit(s, fits, series.longest_chunk(s), 0.01, 50.0, nightly=nightly, baseline=b).first()
    res, ks = 1 / span, 10.0 if nightly else 15.0
    guard, side = 3 * (2 / span), max(ks * res, (6 if nightly else 4) * res)
    lo, hi = max(0.01, 1.7 - (guard + side)), min(50.0, 1.7 + (guard + side))
    n = min(max(int(np.floor((hi - lo) / (res / 5))) + 1, 11), 1601 if nightly else 1201)
    f, w = np.linspace(lo, hi, n), 1 / ERR**2
    base = design(nightly, False)
    drop = np.array([solve(base, Y, w)[1] - solve(np.column_stack([waves(x), base]), Y, w)[1] for x in f])
    p = np.maximum(0, drop / solve(base, Y, w)[1]) if nightly else drop / 2
    away, wide = np.abs(f - 1.7), 1.0
    for _ in range(6):
        m = (away >= guard) & (away <= guard + wide * side)
        noise = trimmed(p[m])
        if noise > 0 and m.sum() >= 12:
            break
        wide *= 1.5
    assert np.isclose(got.w, p[away <= guard].max() / noise, rtol=1e-6)


def slow_prominence(y, k):
    left = k
    while left > 0 and y[left - 1] <= y[k]:
        left -= 1
    right = k
    while right < len(y) - 1 and y[right + 1] <= y[k]:
        right += 1
    return y[k] - max(y[left : k + 1].min(), y[k : right + 1].min())


def slow_peaks(y):
    out, k = [], 1
    while k < len(y) - 1:
        end = k
        while end < len(y) - 1 and y[end + 1] == y[k]:
            end += 1
        if y[k - 1] < y[k] and end < len(y) - 1 and y[end + 1] < y[k]:
            out.append((k + end) // 2)
        k = end + 1
    return out


@pytest.mark.parametrize("levels", [2, 4, 1000])
def test_prominences(levels):
    """Plateaus and ties: few levels give many."""
    rng = np.random.default_rng(levels)
    for n in (0, 1, 2, 3, 7, 300):
        y = rng.integers(0, levels, n).astype(float)
        peaks = spectrum._peaks(y)
        assert peaks.tolist() == slow_peaks(y)
        low = np.maximum(spectrum._lowest_before_higher(y.tolist()), spectrum._lowest_before_higher(y[::-1].tolist())[::-1]) if n else []
        assert [y[k] - low[k] for k in peaks] == [slow_prominence(y, k) for k in peaks]


def test_peaks_are_spaced_before_their_prominence_counts(spark):
    y = [0, 5.0, 4.9, 6.0, 0.0, 0.5, 0.2, 3.0, 0]
    spec = spark.createDataFrame([("a", j, float(j), float(v)) for j, v in enumerate(y)] + [("b", j, float(j), None) for j in range(5)], "series_id string, j long, f double, power double")
    assert [(r.j, r.rank) for r in spectrum.top_peaks(spec, 5, 3.0, 1.0).orderBy("rank").collect()] == [(3, 1), (7, 2)]
