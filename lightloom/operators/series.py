"""Time-series operators: cleaning, segments, nights, robust statistics, folding. Every one works on many series at once.

A series is rows (series_id, t, y, ...) with a unique tiebreak column ``k``; order is always (t, k). Nothing here needs a
series to be sorted, and a series' rows meet only in windows partitioned by series_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.waves import finite

ROBUST = 1.4826


def by(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("series_id",)))


def ordered(*keys: str) -> Window:
    return by(*keys).orderBy("t", "k")


def clean(series: DataFrame, y: str = "y", err: str | None = None) -> DataFrame:
    """Finite t and y only; where errors are given, only positive finite ones."""
    out = series.withColumn("t", finite(F.col("t"))).withColumn(y, finite(F.col(y))).filter(F.col("t").isNotNull() & F.col(y).isNotNull())
    return out if err is None else out.withColumn(err, finite(F.col(err))).filter(F.col(err) > 0)


def good_quality(rows: DataFrame, quality: str = "quality") -> DataFrame:
    return rows.filter(finite(F.col("t")).isNotNull() & (F.col(quality) == 0))


def good_quality_or_all(rows: DataFrame, quality: str = "quality") -> DataFrame:
    """Rows of quality 0; all rows of a series that has none."""
    any_good = F.count_if(F.col(quality) == 0).over(by())
    return rows.withColumn("any_good", any_good).filter((F.col("any_good") == 0) | (F.col(quality) == 0)).drop("any_good")


def main_flux(rows: DataFrame, preferred: str, other: str) -> Column:
    """A series' preferred column if it has any value there, else the other."""
    return F.when(F.count(finite(F.col(preferred))).over(by()) > 0, F.col(preferred)).otherwise(F.col(other))


def relative_time(t: str = "t") -> Column:
    return F.col(t) - F.min(t).over(by())


def absolute_time(t: str = "t_abs", zero: float = 2457000.0, far: float = 1e6) -> Column:
    """Times on a long scale (median over ``far``) lose the zero point."""
    return F.when(F.median(t).over(by()) > far, F.col(t) - zero).otherwise(F.col(t))


def gap_segments(series: DataFrame, gap: float, name: str = "segment", keys: tuple = ("series_id",)) -> DataFrame:
    """A new segment begins where the step exceeds ``gap`` (an equal step does not)."""
    step = F.col("t") - F.lag("t").over(ordered(*keys))
    return series.withColumn(name, F.sum(F.when(step > gap, 1).otherwise(0)).over(ordered(*keys)))


def day_groups(name: str = "night") -> Column:
    """Dense number of the whole day."""
    return F.dense_rank().over(by().orderBy(F.floor("t"))) - 1


def label_groups(series: DataFrame, label: str, name: str = "night") -> DataFrame:
    """Numbers of labels by first appearance; rows without a label form a group of their own."""
    named = series.withColumn("label_", F.coalesce(F.col(label), F.lit("__MISSING_GROUP__")))
    first = F.min(F.struct("t", "k")).over(by("series_id", "label_"))
    named = named.withColumn("first_", first)
    return named.withColumn(name, F.dense_rank().over(by().orderBy("first_")) - 1).drop("label_", "first_")


def longest_chunk(series: DataFrame, gap: float = 1.0) -> DataFrame:
    """(series_id, t_full, t_chunk): the span, and the longest run of two points or more without a gap (else the span)."""
    segments = gap_segments(series, gap).groupBy("series_id", "segment")
    segments = segments.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    chunk = F.max(F.when(F.col("n") >= 2, F.col("b") - F.col("a")))
    span = F.max("b") - F.min("a")
    return segments.groupBy("series_id").agg(span.alias("t_full"), F.coalesce(chunk, span).alias("t_chunk"))


def step_noise(series: DataFrame, y: str = "y", least: int = 10) -> DataFrame:
    """(series_id, hf): standard deviation of first differences, null under ``least`` points."""
    steps = series.withColumn("dy", F.col(y) - F.lag(y).over(ordered()))
    return steps.groupBy("series_id").agg(F.when(F.count(y) >= least, F.stddev_pop("dy")).alias("hf"))


def robust_step_noise(series: DataFrame, y: str = "y") -> DataFrame:
    """(series_id, sigma): MAD of differences / 0.6745 / sqrt 2, the standard deviation where the MAD is 0."""
    steps = series.withColumn("dy", F.col(y) - F.lag(y).over(ordered()))
    steps = steps.withColumn("dev", F.abs(F.col("dy") - F.median("dy").over(by())))
    mad = F.median("dev")
    sigma = F.when(mad > 0, mad / 0.6745).otherwise(F.stddev_pop("dy")) / F.sqrt(F.lit(2.0))
    return steps.groupBy("series_id").agg(F.when(F.count(y) >= 5, sigma).alias("sigma"))


def level(y: str = "y", *keys: str, zero: str = "keep") -> Column:
    """y over the median of its group; a group whose median is 0 or missing keeps its values, or with ``zero='null'`` has none."""
    m = F.median(y).over(by(*keys))
    return F.when(m != 0, F.col(y) / m).otherwise(F.col(y) if zero == "keep" else F.lit(None).cast("double"))


def with_any_flux(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of series that have a finite value in one of ``columns`` at least once."""
    some = F.coalesce(*[finite(F.col(c)) for c in columns])
    return rows.withColumn("some_", F.count(some).over(by())).filter("some_ > 0").drop("some_")


def rms_ppm(x: str) -> Column:
    return 1e6 * F.stddev_pop(x)


def amplitude_metric(y: str = "y", low: float = 0.01, high: float = 0.99, least: int = 10) -> Column:
    return F.when(F.count(y) >= least, F.percentile(y, F.lit(high)) - F.percentile(y, F.lit(low)))


def robust_sigma(series: DataFrame, y: str = "y") -> DataFrame:
    """(series_id, mad, sigma)."""
    away = series.withColumn("dev", F.abs(F.col(y) - F.median(y).over(by())))
    return away.groupBy("series_id").agg(F.median("dev").alias("mad"), (ROBUST * F.median("dev")).alias("sigma"))


def trimmed_median(rows: DataFrame, value: str, trim: float, *keys: str) -> DataFrame:
    """(keys, trimmed): median of what is left without the top ``trim`` share."""
    keys = keys or ("series_id",)
    ranked = rows.filter(F.col(value).isNotNull()).withColumn("rank_", F.row_number().over(by(*keys).orderBy(value)))
    ranked = ranked.withColumn("keep_", F.greatest(F.lit(1), F.floor((1 - trim) * F.count("*").over(by(*keys)))))
    return ranked.filter("rank_ <= keep_").groupBy(*keys).agg(F.median(value).alias("trimmed"))


def phase_bin_means(series: DataFrame, phase: Column, width: float, least: int = 1) -> DataFrame:
    bins = series.withColumn("bin", F.floor(phase / width))
    out = bins.groupBy("series_id", "bin").agg(F.avg("y").alias("mean"), F.count("y").alias("n"))
    return out.filter(F.col("n") >= least)


def phase_bin_medians(series: DataFrame, phase: Column, bins: int) -> DataFrame:
    """Equal bins, the last one closed."""
    numbered = series.withColumn("bin", F.least(F.floor(phase * bins), F.lit(bins - 1)))
    return numbered.groupBy("series_id", "bin").agg(F.median("y").alias("median"), F.count("y").alias("n"))


def local_maxima(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Rows strictly above both neighbours."""
    w = by(*(keys or ("series_id",))).orderBy(order)
    near = rows.withColumn("before_", F.lag(value).over(w)).withColumn("after_", F.lead(value).over(w))
    return near.filter((F.col(value) > F.col("before_")) & (F.col(value) > F.col("after_"))).drop("before_", "after_")
