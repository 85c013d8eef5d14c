"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; its hash is 96 bits (two independent
functions). Documents come in batches. A batch's keys, counted once a document, merge-anti-join the keys that the runs
already hold as frequent and become a sorted run of level 0; when a level has ``fanout`` runs, they are merged into one
run of the next level. In the end one merge of the runs that are left names the keys that ``min_docs`` documents hold,
and each document loses those lines.

Only hashes are shuffled for the counts (pre-aggregated within a task, so a very common line is one row a task), and
only (document, line number) pairs of dropped lines meet their documents again.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped; a document
that loses all lines has the empty text; rows that repeat count as documents of their own; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, discard, gives_back, salted_join, stored

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2


def line_keys(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(ascii_lower(line), F.lit(SPACES)))


def _hashes(min_chars: int) -> Column:
    """For each line its 96-bit hash, or null where the key is too short."""
    hashed = lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g")))
    return F.transform(line_keys(F.col("text")), hashed)


def _merged(runs: list[DataFrame]) -> DataFrame:
    """One sorted run from several."""
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    return every.groupBy("h", "g").agg(F.sum("n").alias("n")).sortWithinPartitions("h", "g")


class LineRuns:
    """The levels of runs; ``add`` takes one batch of distinct (document, line hash) rows."""

    def __init__(self, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        fresh = keys.groupBy("h", "g").agg(F.count("*").alias("n"))
        for run in self.runs():
            known = run.filter(F.col("n") >= self.min_docs).hint("merge")
            fresh = fresh.join(known, ["h", "g"], "left_anti")
        self.levels[0].append(stored(fresh.sortWithinPartitions("h", "g"), "line-run"))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(stored(_merged(old), "line-run"))
            self.levels[level] = []
            for run in old:
                discard(run)
            level += 1

    def frequent(self) -> DataFrame:
        return stored(_merged(self.runs()).filter(F.col("n") >= self.min_docs).select("h", "g", "n"), "line-frequent")


def dedup_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` as struct ``d``, with n_lines (before), n_dropped and kept (the text that stays)."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), _hashes(min_chars).alias("lines"))
    batch = F.pmod(F.hash("doc_id", "t"), F.lit(batches))
    path = stored(keyed.withColumn("batch", batch), "line-hashes")
    runs = LineRuns(min_docs, fanout)
    for b in range(batches):
        own = path.filter(F.col("batch") == b).select(F.explode(F.array_distinct("lines")).alias("k"))
        runs.add(own.filter("k is not null").select("k.h", "k.g"))
    frequent = runs.frequent()
    for run in runs.runs():
        discard(run)

    lines = path.select("doc_id", "t", F.posexplode("lines").alias("at", "k")).filter("k is not null")
    keyed_lines = lines.select("doc_id", "t", "at", F.struct("k.h", "k.g").alias("key"))
    hits = salted_join(keyed_lines, frequent.select(F.struct("h", "g").alias("key"), "n"), "key", "doc_id")  # a line may be in every document
    drops = hits.groupBy(F.col("doc_id").alias("i"), F.col("t").alias("u")).agg(F.collect_set("at").alias("drops"))
    whole = docs.select(F.struct("*").alias("d"))
    same = F.col("d.doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("d.text") == F.col("u"))
    joined = whole.join(drops, same, "left").select("d", F.col("d.text").alias("text"), "drops")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(part.column("text"), part.column("drops"), strict=True):
                lines = (text.as_py() or "").split("\n")
                gone = set(drops.as_py() or ())
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text.as_py() or "")
            made = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("d"), *made], ["d", "n_lines", "n_dropped", "kept"])

    schema = whole.schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    return joined.mapInArrow(gives_back(cut), schema)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    cut = dedup_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    return cut.select(F.col("d.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> DataFrame:
    """``docs`` with the texts that stay; a null text stays null."""
    cut = dedup_lines(docs, min_docs, min_chars)
    text = F.when(F.col("d.text").isNotNull(), F.col("kept"))
    return cut.select(cut["d"].withField("text", text).alias("d")).select("d.*")
