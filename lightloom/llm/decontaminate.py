"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over all training token windows.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. A window is ``n`` consecutive
words of a benchmark item (an item of fewer words is one window). Windows become 64-bit sums of word codes, looked up in
a sorted array; each hit is then verified word by word. The benchmark's windows are sent to executors in pieces of at
most ``max_windows`` windows; a larger benchmark takes more passes over the documents, whose findings are merged.

Defined results: null texts have no words; items without a text have no windows, items
without an item_id hit but are not listed; repeated items count once by item_id; rows that repeat
are documents of their own; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, gives_back

WINDOW = 10
MAX_WINDOWS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def _code(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _window_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Of each n consecutive words, one 64-bit code."""
    count = len(codes) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for k in range(n if count > 0 else 0):
        out *= _ODD
        out += codes[k : k + count]
    return out


class _Index:
    """Windows of the benchmark by length: sorted codes for the scan, the words for verification."""

    def __init__(self, windows: dict[tuple, set[str]]):
        vocabulary = sorted({w for window in windows for w in window})
        self.code = {w: _code(w) for w in vocabulary}
        self.items = windows
        self.by_length: dict[int, np.ndarray] = {}
        self.filters: dict[int, np.ndarray] = {}
        for n in {len(w) for w in windows}:
            rows = np.array([[self.code[w] for w in window] for window in windows if len(window) == n], np.uint64)
            sums = np.zeros(len(rows), np.uint64)
            for k in range(n):
                sums = sums * _ODD + rows[:, k]
            self.by_length[n] = np.unique(sums)
            self.filters[n] = np.zeros(1 << 20, bool)
            self.filters[n][self.by_length[n] >> np.uint64(44)] = True

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of verified hits, and the items that they belong to."""
        spans, items = [], set()
        if not words or not self.items:
            return spans, items
        get = self.code.get
        codes = np.array([get(w, 0) for w in words], np.uint64)
        for n, known in self.by_length.items():
            sums = _window_codes(codes, n)
            at = np.flatnonzero(self.filters[n][sums >> np.uint64(44)])
            if len(at):
                place = np.minimum(np.searchsorted(known, sums[at]), len(known) - 1)
                at = at[known[place] == sums[at]]
            for i in at.tolist():
                found = self.items.get(tuple(words[i : i + n]))
                if found is not None:
                    spans.append((i, i + n))
                    items |= found
        return spans, items


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows (arrays of words) with their items."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, item = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                grams = [words[k : k + n] for k in range(max(1, len(words) - n + 1))] if words else []
                window += grams
                item += [i] * len(grams)
            yield pa.RecordBatch.from_arrays([pa.array(window, pa.list_(pa.binary())), pa.array(item, pa.string())], ["window", "item"])

    picked = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return picked.mapInArrow(gives_back(windows), "window array<binary>, item string").groupBy("window").agg(
        F.collect_set("item").alias("items")
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All columns of ``docs`` as struct ``d``, with n_words, spans (array of [start, end) word spans, merged), items."""
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, n)
    count = windows.count()
    passes = -(-count // max_windows) or 1
    part = F.pmod(F.xxhash64("window"), F.lit(passes))
    out = docs.select(F.struct("*").alias("d"), F.lit(0).cast("long").alias("n_words"))
    out = out.withColumns({"starts": F.array().cast("array<int>"), "ends": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for p in range(passes):
        rows = (windows.filter(part == p) if passes > 1 else windows).collect()
        index = spark.sparkContext.broadcast({tuple(map(bytes, r[0])): set(r[1]) for r in rows})

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            lookup = _Index(index.value)
            for batch in batches:
                texts = batch.column("d").field("text")
                n_words, starts, ends, items = [], [], [], []
                for k, text in enumerate(texts):
                    words = words_of(text.as_py())
                    spans, found = lookup.find(words)
                    if p and len(batch.column("starts")[k]):
                        spans += zip(batch.column("starts")[k].as_py(), batch.column("ends")[k].as_py(), strict=True)
                        found |= set(batch.column("items")[k].as_py())
                    edges = np.flatnonzero(np.diff(np.r_[False, _covered(spans, len(words)), False])) if spans else []
                    n_words.append(len(words))
                    starts.append(list(map(int, edges[::2])))
                    ends.append(list(map(int, edges[1::2])))
                    items.append(sorted(found))
                made = [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("d"), *made], ["d", "n_words", "starts", "ends", "items"])

        out = out.mapInArrow(gives_back(scan), out.schema)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark, n, max_windows)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        F.col("d.doc_id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, how: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``how='spans'``) with the hit words cut out of their texts.

    Cut texts keep their other characters; what stood between two removed words goes with them.
    """
    found = find_contamination(docs, benchmark, n)
    if how == "documents":
        return found.filter(F.size("starts") == 0).select("d.*")
    if how != "spans":
        raise ValueError("how is 'documents' or 'spans'")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_cut(t, a, b) for t, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True)]
            yield batch.set_column(0, "text", pa.array(texts, pa.string()))

    narrow = found.select(F.col("d.text").alias("text"), "starts", "ends", "d")
    cleaned = narrow.mapInArrow(gives_back(cut), narrow.schema)
    return cleaned.select(cleaned["d"].withField("text", F.col("text")).alias("d")).select("d.*")


def _cut(text: str | None, starts: list[int], ends: list[int]) -> str | None:
    if not text or not starts:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(raw.translate(ALNUM_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, flat, False].astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(raw[at : first[a]])
        at = last[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
