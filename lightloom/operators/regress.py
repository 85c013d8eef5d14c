"""Least squares for many series at once: Spark sums the normal equations, a task solves one small system a series."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..tables import stored
from .series import ROBUST, by


_VECTOR = T.ArrayType(T.DoubleType())
#: Designs of more columns than this are summed as matrix products in Arrow; their sums are too many for one aggregate.
WIDE = 12


def _wide_sums(rows: DataFrame, features: list[str], y: str, weight: Column, keys: tuple) -> DataFrame:
    """As ``normal_sums``: a task's rows give one matrix a key, of which the entries are added by Spark."""
    p = len(features)
    named = rows.select(*keys, weight.cast("double").alias("w_"), F.array(*[F.col(f).cast("double") for f in features], F.col(y).cast("double")).alias("x_"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, own in batch.groupby(list(keys), dropna=False, sort=False):
                x, w = np.stack(own["x_"].to_numpy()), own["w_"].to_numpy()
                total = np.r_[((x * w[:, None]).T @ x).ravel(), np.count_nonzero(w > 0)]
                out.append((*key, total))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "sums"])

    schema = T.StructType([named.schema[k] for k in keys]).add("sums", _VECTOR)
    each = named.mapInPandas(add, schema).select(*keys, F.posexplode("sums").alias("at", "v"))
    packed = each.groupBy(*keys, "at").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("m"))
    at = lambda i, j: F.get("m", F.lit(i * (p + 1) + j))
    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.slice("m", i * (p + 1) + 1, p)))
    return packed.select(*keys, inner.alias("xx"), F.slice("m", p * (p + 1) + 1, p).alias("xy"), at(p, p).alias("yy"), at(p + 1, 0).cast("long").alias("n"))


def normal_sums(rows: DataFrame, features: list[str], y: str, weight: Column | None = None, keys: tuple = ("series_id",)) -> DataFrame:
    """(keys, xx: p * p sums, xy: p sums, yy, n) of weighted products."""
    w = F.lit(1.0) if weight is None else weight
    if len(features) > WIDE:
        return _wide_sums(rows, features, y, w, keys)
    named = rows.select(*keys, w.alias("w_"), F.col(y).alias("y_"), *[F.col(f).alias(f"x{k}_") for k, f in enumerate(features)])
    p = range(len(features))
    pairs = [F.sum(F.col("w_") * F.col(f"x{i}_") * F.col(f"x{j}_")).alias(f"xx{i}_{j}") for i in p for j in p if j >= i]
    sums = named.groupBy(*keys).agg(*pairs, *[F.sum(F.col("w_") * F.col(f"x{i}_") * F.col("y_")).alias(f"xy{i}") for i in p], F.sum(F.col("w_") * F.col("y_") * F.col("y_")).alias("yy"), F.count_if(F.col("w_") > 0).alias("n"))
    xx = F.array(*[F.col(f"xx{min(i, j)}_{max(i, j)}") for i in p for j in p])
    return sums.select(*keys, xx.alias("xx"), F.array(*[F.col(f"xy{i}") for i in p]).alias("xy"), "yy", "n")


def least_norm(a: np.ndarray, b: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pseudo-inverses, least-norm solutions, residual sums of squares) of many normal equations; ``a`` is overwritten."""
    whole = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1)
    a[~whole] = 0.0
    diagonal = np.einsum("kii->ki", a)
    scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    outer = scale[:, :, None] * scale[:, None, :]
    inverse = np.linalg.pinv(a / outer, rcond=1e-12, hermitian=True) / outer
    beta = np.einsum("kij,kj->ki", inverse, b)
    return inverse, beta, np.maximum(yy - np.einsum("ki,ki->k", beta, b), 0.0)


@F.pandas_udf(T.StructType().add("beta", _VECTOR).add("cov", _VECTOR).add("rss", T.DoubleType()))
def solve(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Least-norm solution, covariance (pseudo-inverse times rss / max(n - p, 1)) and residual sum of squares."""
    if not len(xx):
        return pd.DataFrame({"beta": [], "cov": [], "rss": []})
    b = np.stack([np.asarray(x, float) for x in xy])
    a = np.stack([np.asarray(x, float) for x in xx]).reshape(len(b), b.shape[1], b.shape[1])
    inverse, beta, rss = least_norm(a, b, yy.to_numpy(float))
    cov = inverse * (rss / np.maximum(n.to_numpy(float) - b.shape[1], 1))[:, None, None]
    return pd.DataFrame({"beta": list(beta), "cov": list(cov.reshape(len(b), -1)), "rss": rss})


def least_squares(rows: DataFrame, features: list[str], y: str, weight: Column | None = None, keys: tuple = ("series_id",)) -> DataFrame:
    """(keys, beta, cov, rss, n)."""
    sums = normal_sums(rows, features, y, weight, keys)
    return sums.withColumn("fit_", solve("xx", "xy", "yy", "n")).select(*keys, "fit_.*", "n")


def predicted(features: list[str], beta: str = "beta") -> Column:
    total = F.lit(0.0)
    for k, f in enumerate(features):
        total = total + F.get(beta, F.lit(k)) * F.col(f)
    return total


def poly_features(series: DataFrame, order: int, keys: tuple = ("series_id",)) -> tuple[DataFrame, list[str]]:
    """Powers of time, centred and scaled within a series."""
    w = by(*keys)
    u = (F.col("t") - F.avg("t").over(w)) / F.greatest((F.max("t").over(w) - F.min("t").over(w)) / 2, F.lit(1e-12))
    out = series.withColumn("u_", u)
    names = [f"pow{k}" for k in range(order + 1)]
    return out.withColumns({n: F.pow("u_", F.lit(float(k))) for k, n in enumerate(names)}).drop("u_"), names


def poly_detrended(series: DataFrame, order: int, weight: Column | None = None, y: str = "y") -> DataFrame:
    """y minus the fitted polynomial; a series of fewer than max(3, order + 2) points stays as it is."""
    rows, names = poly_features(series, order)
    fits = least_squares(rows, names, y, weight).select("series_id", F.when(F.col("n") >= max(3, order + 2), F.col("beta")).alias("beta"))
    fitted = rows.join(fits, "series_id", "left")
    return fitted.withColumn(y, F.col(y) - F.coalesce(predicted(names), F.lit(0.0))).select(*series.columns)


def hinges(series: DataFrame, spacing: float) -> tuple[DataFrame, list[str]]:
    """max(0, t - knot) at the inner knots every ``spacing`` from a series' first time: as many as the longest series has (a
    shorter one's others are zero)."""
    spans = series.groupBy("series_id").agg((F.max("t") - F.min("t")).alias("span"))
    knots = spans.agg(F.max(F.ceil(F.col("span") / spacing) - 1)).first()[0] or 0
    first, last = F.min("t").over(by()), F.max("t").over(by())
    out = series.withColumns({"first_": first, "last_": last})
    names = [f"hinge{k}" for k in range(1, int(knots) + 1)]
    knot = {n: F.col("first_") + spacing * k for k, n in enumerate(names, 1)}
    out = out.withColumns({n: F.when((x < F.col("last_")) & (F.col("t") > x), F.col("t") - x).otherwise(0.0) for n, x in knot.items()}) if names else out
    return out.drop("first_", "last_"), names


def hinge_features(series: DataFrame, columns: list[str], spacing: float = float("inf")) -> tuple[DataFrame, list[str]]:
    """1, columns less their medians, and hinges."""
    out = series.withColumns({f"{c}_c": F.col(c) - F.median(c).over(by()) for c in columns}).withColumn("one", F.lit(1.0))
    out, more = hinges(out, spacing) if spacing != float("inf") else (out, [])
    return out, ["one", *[f"{c}_c" for c in columns], *more]


def extractor_features(series: DataFrame, x: str, y: str, background: str | None = None, width: str | None = None, spacing: float = float("inf")) -> tuple[DataFrame, list[str]]:
    """1, x, y, x2, y2, xy, t, t2, t3 about medians; where given the width with its square, hinges (for series of more than two
    spacings), and the background with its square."""
    given = [c for c in (x, y, "t", width, background) if c]
    out = series.withColumns({f"{c}_c": F.col(c) - F.median(c).over(by()) for c in given}).withColumn("one", F.lit(1.0))
    a, b, t = F.col(f"{x}_c"), F.col(f"{y}_c"), F.col("t_c")
    more = {"xx_c": a * a, "yy_c": b * b, "xy_c": a * b, "tt_c": t * t, "ttt_c": t * t * t}
    more |= {f"{c}_cc": F.col(f"{c}_c") * F.col(f"{c}_c") for c in (width, background) if c}
    out = out.withColumns(more)
    names = ["one", f"{x}_c", f"{y}_c", "xx_c", "yy_c", "xy_c", "t_c", "tt_c", "ttt_c", *([f"{width}_c", f"{width}_cc"] if width else [])]
    if spacing != float("inf"):
        out, own = hinges(out, spacing)
        long = (F.max("t").over(by()) - F.min("t").over(by())) > 2 * spacing
        out = out.withColumn("long_", long)
        out = out.withColumns({n: F.when(F.col("long_"), F.col(n)).otherwise(0.0) for n in own}).drop("long_") if own else out.drop("long_")
        names += own
    return out, [*names, *([f"{background}_c", f"{background}_cc"] if background else [])]


#: A series of so many points at most is fitted whole by one task, all rounds at once.
WHOLE = 50_000


def pseudo_solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least-norm solution of one system of normal equations, as ``solve`` finds it; zeros where a sum is not finite."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        a = np.zeros_like(a)
    diagonal = np.diagonal(a)
    scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
    outer = np.outer(scale, scale)
    return (np.linalg.pinv(a / outer, rcond=1e-12, hermitian=True) / outer) @ b


def _huber(x: np.ndarray, y: np.ndarray, rounds: int, stop: bool) -> np.ndarray:
    """The coefficients of ``robust_fit`` for one series."""
    beta = pseudo_solved(x.T @ x, x.T @ y)
    for _ in range(rounds):
        rest = y - x @ beta
        mad = ROBUST * np.median(np.abs(rest - np.median(rest)))
        if stop and mad == 0:
            break
        sigma = mad if mad > 0 else rest.std()
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.abs(rest) / (1.5 * sigma)
            weight = np.where(u > 1, 1 / u, 1.0) if sigma > 0 else np.ones(len(y))
        former, beta = beta, pseudo_solved((x * weight[:, None]).T @ x, x.T @ (weight * y))
        if stop and (np.abs(former - beta) <= 1e-9 + 1e-6 * np.abs(former)).all():
            break
    return beta


def robust_fit(rows: DataFrame, features: list[str], y: str, rounds: int = 8, keys: tuple = ("series_id",), stop: bool = False) -> DataFrame:
    """Huber weights by reweighted least squares; (keys, beta). A round scales residuals by 1.4826 MAD (the standard deviation where
    that is 0) and refits. With ``stop`` a series keeps its coefficients once its MAD is 0 or they have settled.

    Series of ``WHOLE`` complete points at most meet once in one task each, which does their rounds; longer ones, and those with
    gaps in y or a feature, go through the rounds in step (``_robust_rounds``)."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, *features)])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size_"), F.count_if(whole).alias("complete_"))
    large = stored(sizes.filter((F.col("size_") > WHOLE) | (F.col("size_") > F.col("complete_"))).select(*keys), "large")
    small = rows.join(F.broadcast(large), list(keys), "left_anti").filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    named = small.select(*keys, F.array(*[F.col(f).cast("double") for f in features], F.col(y).cast("double")).alias("x_"))
    schema, p = T.StructType([named.schema[k] for k in keys]).add("beta", _VECTOR), len(features)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, points, out = {}, 0, []
        for batch in itertools.chain(batches, [None]):  # rows come sorted by key: only the last one may go on
            if batch is not None:
                code = np.zeros(batch.num_rows, np.int64)
                for k in keys:
                    own = pc.dictionary_encode(batch.column(k), null_encoding="encode")
                    code = code * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
                values = batch.column("x_").flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
                edges = np.r_[0, np.flatnonzero(np.diff(code)) + 1, batch.num_rows] if batch.num_rows else [0]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    held.setdefault(tuple(batch.column(k)[int(a)].as_py() for k in keys), []).append(values[a:b])
            for key in list(held)[: -1 if batch is not None else None]:
                x = np.concatenate(held.pop(key))
                out.append((*key, _huber(x[:, :p], x[:, p], rounds, stop)))
            if out and (batch is None or len(out) > 1000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)
                out = []

    kinds = [to_arrow_type(f.dataType) for f in schema]
    fits = named.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fit, schema)
    if large.isEmpty():
        return fits
    return fits.unionByName(_robust_rounds(rows.join(large, list(keys), "left_semi"), features, y, rounds, keys, stop))


def _robust_rounds(rows: DataFrame, features: list[str], y: str, rounds: int, keys: tuple, stop: bool) -> DataFrame:
    """``robust_fit`` by Spark's own sums: all series in step, a round joins the last coefficients (one row a series)."""
    w = by(*keys)
    fits = least_squares(rows, features, y, keys=keys).select(*keys, "beta", F.lit(False).alias("done"))
    for _ in range(rounds):
        fits = stored(fits, "fits")
        res = rows.join(fits, list(keys)).withColumn("res_", F.col(y) - predicted(features))
        res = res.withColumn("dev_", F.abs(F.col("res_") - F.median("res_").over(w)))
        res = res.withColumn("mad_", ROBUST * F.median("dev_").over(w))
        sigma = F.when(F.col("mad_") > 0, F.col("mad_")) if stop else F.when(F.col("mad_") > 0, F.col("mad_")).otherwise(F.stddev_pop("res_").over(w))
        u = F.abs(F.col("res_")) / (1.5 * F.nullif(sigma, F.lit(0.0)))
        weighted = res.withColumn("wt_", F.when(u <= 1, 1.0).otherwise(F.coalesce(1 / u, F.lit(1.0))))
        new = least_squares(weighted, features, y, F.col("wt_"), keys).select(*keys, F.col("beta").alias("new"))
        flat = weighted.groupBy(*keys).agg(F.max("mad_").alias("mad_"))
        near = F.forall(F.zip_with("beta", "new", lambda a, b: F.abs(a - b) <= 1e-9 + 1e-6 * F.abs(a)), lambda ok: ok)
        joined = fits.join(new, list(keys)).join(flat, list(keys))
        frozen = F.col("done") | ((F.col("mad_") == 0) if stop else F.lit(False))
        fits = joined.select(*keys, F.when(frozen, F.col("beta")).otherwise(F.col("new")).alias("beta"), (frozen | (near if stop else F.lit(False))).alias("done"))
    return fits.select(*keys, "beta")


def decorrelated(rows: DataFrame, features: list[str], y: str, fits: DataFrame, keys: tuple = ("series_id",), least: int = 0) -> DataFrame:
    """y - fit + median(y), as ``decorrelated``; a series of no more than ``least`` rows that have y and all features, or without a
    fit, keeps its values."""
    out = rows.join(fits.select(*keys, "beta"), list(keys), "left")
    whole = F.count(F.when(F.col(y).isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features]), 1)).over(by(*keys))
    fitted = F.col(y) - predicted(features) + F.median(y).over(by(*keys))
    return out.withColumn("decorrelated", F.when((whole > least) & F.col("beta").isNotNull(), fitted).otherwise(F.col(y))).drop("beta")


def split_decorrelated(rows: DataFrame, x: str, y: str, background: str, half: str, least: int = 200, whole: int = 300, rounds: int = 8) -> DataFrame:
    """A robust fit of the extractor design on each side of ``half``; a side of fewer than ``least`` points, or a series of no more
    than ``whole``, keeps its values as ``decorrelated``."""
    keys = ("series_id", half)
    sized = rows.withColumns({"side_": F.count("y").over(by(*keys)), "all_": F.count("y").over(by())})
    enough = (F.col("side_") >= least) & (F.col("all_") > whole)
    features, names = extractor_features(sized, x, y, background)
    features = stored(features, "split")
    out = decorrelated(features, names, "y", robust_fit(features.filter(enough), names, "y", rounds, keys, stop=True), keys)
    return out.withColumn("decorrelated", F.when(enough, F.col("decorrelated")).otherwise(F.col("y"))).drop("side_", "all_")


def background_scale(series: DataFrame, background: str, steps: int = 200, factor: float = 2.0, least: int = 100) -> DataFrame:
    """(series_id, k): the multiple of the background whose removal leaves the least noise of first differences over the
    median; 0 for series of fewer than ``least`` points or without a background. The noise of a multiple follows from three
    sums over the differences; only its median looks at the samples again, as two arrays a series."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, b in zip(batch.column("y"), batch.column("b"), strict=True):
                y, b = (c.values.to_numpy(zero_copy_only=False) for c in (y, b))  # noqa: PLW2901
                my, mb = np.median(y), np.median(b)
                if len(y) < least or mb == 0:
                    out.append(0.0)
                    continue
                ks, dy, db = np.arange(steps) * (factor * my / mb) / (steps - 1), np.diff(y), np.diff(b)
                (vy, vyb), (_, vb) = np.cov(dy, db, bias=True)
                noise = np.sqrt(np.maximum(vy - 2 * ks * vyb + ks * ks * vb, 0.0))
                block = max(1, (1 << 20) // len(y))
                medians = np.concatenate([np.median(y - ks[a : a + block, None] * b, axis=1) for a in range(0, steps, block)])
                out.append(float(ks[np.argmin(noise / np.where(medians != 0, np.abs(medians), 1.0))]))
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), pa.array(out, pa.float64())], ["series_id", "k"])

    sorted_rows = F.sort_array(F.collect_list(F.struct("t", "k", F.col("y").cast("double").alias("y"), F.col(background).cast("double").alias("b"))))
    own = series.filter(F.col("y").isNotNull() & F.col(background).isNotNull()).groupBy("series_id").agg(sorted_rows.alias("rows"))
    part = lambda c: F.transform("rows", lambda r: r[c]).alias(c)
    # two plain arrays a series: a task's Python looks at the numbers in Arrow's own memory and makes no object of a point
    return own.select("series_id", part("y"), part("b")).mapInArrow(best, T.StructType([series.schema["series_id"]]).add("k", "double"))
