"""What the training-data operators share: word patterns, and the library's scratch tables."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, scratch_root, stored

__all__ = ["ascii_lower", "count_plain_words", "discard", "gives_back", "salted_join", "scratch_root", "short_batches", "stored", "table"]

#: ASCII white space, the only separators of a "plain" word.
SPACE_CLASS = r"\x20\x09-\x0D"
PLAIN_WORD = rf"[^{SPACE_CLASS}]+"
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table: A-Z to a-z, every ASCII byte that is no letter or digit to a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long rows: batches of ``rows`` instead of 10,000 between Spark and its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def gives_back(of_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """For ``mapInArrow``: at its end a task returns what it has freed to the system, since Spark keeps its Python workers."""

    @functools.wraps(of_batches)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of_batches(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else touched."""
    return F.translate(text, UPPER, LOWER)


def count_plain_words(text: Column) -> Column:
    """How many ``PLAIN_WORD`` matches a text has; 0 for null. Each word shrinks to one x, then the spaces go."""
    marks = F.translate(F.regexp_replace(text, PLAIN_WORD, "x"), SPACES, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 64, n: str = "n") -> DataFrame:
    """Inner join on ``key``, of which ``right`` has one row each and ``n``, how many rows of ``left`` have it.

    Keys with over a thousandth of all those rows, fewer than a thousand, are known to every task: their rows on the left
    are dealt into ``salts`` parts by ``by``, and their row on the right goes to each part. ``n`` is dropped.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) * 1000 > total
    heavy = right.filter(hot).select(F.col(key).alias("heavy_"))
    part = F.when(F.col("heavy_").isNotNull(), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")
    dealt = left.join(F.broadcast(heavy), F.col(key) == F.col("heavy_"), "left").withColumn("salt_", part).drop("heavy_")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("salt_", F.explode(every)).drop(n), [key, "salt_"]).drop("salt_")
