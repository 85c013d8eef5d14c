"""The registry of queries: a function (spark, sf_dir) -> DataFrame with its DuckDB SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Day numbers of 2024-01-01 and 1995-01-01, the zeros of the two time axes.
EVENTS_ZERO, LINES_ZERO = 19723, 9131

# The same inputs in SQL, to begin an oracle with.
EVENTS_SQL = f"e AS (SELECT event_type AS series_id, CAST(epoch_us(ts) AS DOUBLE) / 8.64e10 - {EVENTS_ZERO} AS t, value AS y, event_id AS k, user_id FROM events)"
LINES_SQL = f"""l AS (SELECT l_suppkey AS series_id, CAST(epoch_us(l_shipdate) AS DOUBLE) / 8.64e10 - {LINES_ZERO} AS t, l_extendedprice AS y,
  l_discount AS x, l_tax AS x2, l_quantity AS b, l_returnflag AS run, l_orderkey * 10 + l_linenumber AS k FROM lineitem)"""
PIXELS_SQL = """px AS (SELECT stamp_id, cadence, CAST(floor((pos - 1) / 8) AS INTEGER) AS "row", CAST((pos - 1) % 8 AS INTEGER) AS col, CAST(v AS DOUBLE) AS flux
  FROM (SELECT label AS stamp_id, vec_id AS cadence, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)),
im AS (SELECT stamp_id, "row", col, avg(flux) AS value FROM px GROUP BY ALL)"""

#: PCHIP through knots kn (series_id, x, v) in SQL: the pieces iv, to be joined by ASOF on at, and the value at a place.
PCHIP = """h AS (SELECT *, lead(x) OVER w - x AS h, (lead(v) OVER w - v) / (lead(x) OVER w - x) AS m FROM kn WINDOW w AS (PARTITION BY series_id ORDER BY x)),
n AS (SELECT *, lag(h) OVER w AS h0, lag(m) OVER w AS m0, lead(h) OVER w AS h2, lead(m) OVER w AS m2, lag(h, 2) OVER w AS hp, lag(m, 2) OVER w AS mp FROM h WINDOW w AS (PARTITION BY series_id ORDER BY x)),
ed AS (SELECT *, CASE WHEN h0 IS NULL THEN ((2 * h + h2) * m - h * m2) / (h + h2) WHEN h IS NULL THEN ((2 * h0 + hp) * m0 - h0 * mp) / (h0 + hp) END AS d0, CASE WHEN h0 IS NULL THEN m ELSE m0 END AS ma, CASE WHEN h0 IS NULL THEN m2 ELSE mp END AS mb FROM n),
sl AS (SELECT series_id, x, v, h, CASE WHEN h0 IS NULL OR h IS NULL THEN CASE WHEN sign(d0) <> sign(ma) THEN 0 WHEN sign(ma) <> sign(mb) AND abs(d0) > 3 * abs(ma) THEN 3 * ma ELSE d0 END
  WHEN m0 * m <= 0 THEN 0 ELSE (3 * h + 3 * h0) / ((2 * h + h0) / m0 + (h + 2 * h0) / m) END AS d FROM ed),
pc AS (SELECT *, lead(v) OVER w AS v1, lead(d) OVER w AS d1, row_number() OVER w AS nr FROM sl WINDOW w AS (PARTITION BY series_id ORDER BY x)),
iv AS (SELECT series_id, x, h, v, v1, d, d1, CASE WHEN nr = 1 THEN -1e18 ELSE x END AS at FROM pc WHERE h IS NOT NULL)"""
PCHIP_VALUE = """(1 + 2 * (({at} - iv.x) / iv.h)) * (1 - ({at} - iv.x) / iv.h) * (1 - ({at} - iv.x) / iv.h) * iv.v + (({at} - iv.x) / iv.h) * (({at} - iv.x) / iv.h) * (3 - 2 * (({at} - iv.x) / iv.h)) * iv.v1
  + iv.h * iv.d * (({at} - iv.x) / iv.h) * (1 - ({at} - iv.x) / iv.h) * (1 - ({at} - iv.x) / iv.h) - iv.h * iv.d1 * (({at} - iv.x) / iv.h) * (({at} - iv.x) / iv.h) * (1 - ({at} - iv.x) / iv.h)"""


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(column: str, zero: int) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(8.64e10) - zero


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series an event type: t in days, y the value, k the event."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), _days("ts", EVENTS_ZERO).alias("t"), F.col("value").alias("y"), F.col("event_id").alias("k"), "user_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series a supplier, with two regressors, a background and a run label."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), _days("l_shipdate", LINES_ZERO).alias("t"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("x"),
        F.col("l_tax").alias("x2"), F.col("l_quantity").alias("b"), F.col("l_returnflag").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp of 8 x 8 pixels a label, a cadence a vector."""
    from ..operators.pixels import from_cubes

    cubes = table(spark, sf_dir, "embeddings").select(F.col("label").alias("stamp_id"), F.col("vec_id").alias("cadence"), F.col("embedding").alias("flux"))
    return from_cubes(cubes, 8)


def _half_away(x: F.Column, digits: int) -> F.Column:
    """As SQL's round of a double: its multiple, to the nearest whole number, halves away from zero. (Spark's own rounds the shortest
    decimal that stands for the double, so 0.06445 goes up though the double's multiple is under 644.5.)"""
    scale = 10.0**digits
    scaled = F.abs(x) * scale
    whole = F.rint(scaled)
    near = F.when(scaled - whole == 0.5, whole + 1).otherwise(whole)
    return F.when(scaled == float("inf"), x).otherwise(F.signum(x) * near / scale)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns (all doubles, if none are named) rounded; minus zero becomes zero."""
    kinds = dict(df.dtypes)
    names = columns or tuple(n for n, kind in kinds.items() if kind == "double")
    return df.withColumns({c: (_half_away(F.col(c), digits) if kinds[c] == "double" else F.round(c, digits)) + 0.0 for c in names})
