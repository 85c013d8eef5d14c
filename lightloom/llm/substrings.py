"""Substring dedup by repeated-phrase automata.

1. Texts with equal words are one class; every document of a class but the first loses all its words at once.
2. Confirm: of each window of ``window`` words the least code among its ``GRAM``-word grams is its anchor, so that equal windows
   have equal anchors; about one position in eight is one. Runs of windows whose anchor recurs are a document's regions; only
   they can hold anything that recurs. Their windows are coded in 96 bits and counted; those that recur are kept once, by
   the place where each starts first.
3. Runs of such places in one document are the recurring passages. They are dealt to shards of about ``SHARD_WORDS`` words.
4. Each shard becomes an Aho-Corasick automaton of tiles of its passages, and the regions of all documents are streamed through
   it. A tile found leads to the windows around it, which are looked up among the shard's windows and verified word by
   word. Every window that is not its own first place is removed.

A region is streamed through the shards that hold an anchor of it; in others nothing of it can be found, since equal windows
have equal anchors. Anchors that passages of several shards have (common phrases) would send a region to ever more shards as the
corpus grows: they have one shard of their own instead (several by the windows' codes, if very many passages have them), which
gets the runs of windows under them, of passages and regions alike, and nothing else of these. A shard that very many regions
meet is compiled for each ``CHUNK_WORDS`` words of them. Anchors and texts that very many documents share are salted where they
are joined.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows that share a doc_id and
the words count as one document, other rows with one doc_id are ordered by a hash of their words; null doc_ids come
first; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, gives_back, salted_join, stored

WINDOW = 20
GRAM = 6
SHARD_WORDS, CHUNK_WORDS = 1_000_000, 4_000_000
#: A common anchor has one shard for so many passages with it.
COMMON_PASSAGES = 10_000
_PART = 480
_FIRST = 0xF0000  # letters of private use
#: Up to so many shards, the table of their sizes (8 bytes each) goes to every task.
BROADCAST_SHARDS = 1_000_000
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _rolling(codes: np.ndarray, n: int, odd: int) -> np.ndarray:
    """A 64-bit code of each n consecutive words, by doubling."""
    out, have, power = codes, 1, odd
    result, done = None, 0
    m = n
    while m:
        if m & 1:
            if result is None:
                result, done = out, have
            else:
                keep = len(codes) - done - have + 1
                result = result[:keep] * np.uint64(power) + out[done : done + keep]
                done += have
        m >>= 1
        if m:
            keep = len(codes) - 2 * have + 1
            out = out[:keep] * np.uint64(power) + out[have : have + keep]
            power = power * power % (1 << 64)
            have *= 2
    result = result ^ (result >> np.uint64(31))
    result = result * _MIX
    return result ^ (result >> np.uint64(29))


def _slid(values: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """``best`` (least or greatest) of each n consecutive values: over 1, 2, 4, ... of them, then the rest."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def _anchors(codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams; for each window its anchor."""
    grams = _rolling(codes, GRAM, 0x9E3779B97F4A7C15)
    return grams, _slid(grams, window - GRAM + 1, np.minimum)


def _places(grams: np.ndarray, own: np.ndarray, window: int) -> np.ndarray:
    """The anchors by their places: grams that are the least of a window."""
    around = np.concatenate([z := np.zeros(window - GRAM, np.uint64), own, z])
    return grams[grams == _slid(around, window - GRAM + 1, np.maximum)]


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchors, and how many windows each has."""
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[first].view(np.int64), np.diff(np.r_[first, len(own)])


def _digest(codes: np.ndarray) -> tuple[int, int]:
    high, low = divmod(xxhash.xxh3_128_intdigest(codes.tobytes()), 1 << 64)
    return high - (1 << 63), low - (1 << 63)


ANCHOR_SCHEMA = "doc_id long, t long, n_words int, h1 long, h2 long, anchors array<long>"


def anchor_table(docs: DataFrame, window: int) -> DataFrame:
    """docs: doc_id, t, text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, h1, h2, anchors = [], [], [], []
            for text in batch.column("text"):
                codes = word_codes(words_of(text.as_py()))
                high, low = _digest(codes)
                found = np.zeros(0, np.uint64)
                if len(codes) >= window:
                    found = _places(*_anchors(codes, window), window)
                n_words.append(len(codes))
                h1.append(high)
                h2.append(low)
                anchors.append(found.view(np.int64))
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(n_words, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            columns.append(pa.array(anchors, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n_words", "h1", "h2", "anchors"])

    return docs.mapInArrow(gives_back(scan), ANCHOR_SCHEMA)


REGION_SCHEMA = "o long, start int, words binary, n int, anchors array<long>, runs array<int>, h array<long>, g array<int>"


def regions(rows: DataFrame, window: int) -> DataFrame:
    """Runs of windows whose anchor recurs, in parts of up to ``_PART`` windows, from o, text and hits (recurring anchors): where
    the run starts, its words and how many, its anchors in order and how many windows each has, and the two codes of each window."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for o, text, hits in zip(*(batch.column(c) for c in ("o", "text", "hits")), strict=True):
                words = words_of(text.as_py())
                codes = word_codes(words)
                wanted, own = np.sort(hits.values.to_numpy()), _anchors(codes, window)[1]
                anchors, n_windows = _runs(own)
                place = np.minimum(np.searchsorted(wanted, anchors), len(wanted) - 1)
                starts = np.flatnonzero(np.repeat(wanted[place] == anchors, n_windows))
                h = _rolling(codes, window, 0xA24BAED4963EE407).view(np.int64)
                g = (_rolling(codes, window, 0x9FB21C651E98DF25).view(np.int64) >> 32).astype(np.int32)
                for run in np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1) if len(starts) else []:
                    for k in range(0, len(run), _PART):
                        a, b = int(run[k]), int(run[min(k + _PART, len(run)) - 1]) + 1
                        out.append((o.as_py(), a, b" ".join(words[a : b + window - 1]), b - a + window - 1, *_runs(own[a:b]), h[a:b], g[a:b]))
            if out:
                longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), longs, ints, longs, ints)
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["o", "start", "words", "n", "anchors", "runs", "h", "g"])

    return rows.select("o", "text", "hits").mapInArrow(gives_back(scan), REGION_SCHEMA)


PASSAGE_SCHEMA = "o long, region int, start int, words binary, n int, anchors array<long>, runs array<int>"


def passages(rows: DataFrame, window: int) -> DataFrame:
    """(o, region, start, words, n, anchors, runs) from regions (o, start, words, anchors, runs) and firsts (first places of recurring
    windows in the region)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for o, start, text, anchors, runs, firsts in zip(*batch.columns, strict=True):
                words, at = text.as_py().split(), np.sort(firsts.values.to_numpy()) - start.as_py()
                own = np.repeat(anchors.values.to_numpy(), runs.values.to_numpy())
                for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
                    a, b = int(run[0]), int(run[-1]) + 1
                    part = b" ".join(words[a : b + window - 1])
                    out.append((o.as_py(), start.as_py(), start.as_py() + a, part, b - a + window - 1, *_runs(own[a:b])))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["o", "region", "start", "words", "n", "anchors", "runs"])

    return rows.select("o", "start", "words", "anchors", "runs", "firsts").mapInArrow(gives_back(cut), PASSAGE_SCHEMA)


def common_runs(rows: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, o, start, words, n): runs of windows under common anchors, from regions or passages (o, start, words, anchors, runs) and
    common, the anchors in question, each with the number of shards it has. Equal windows get the same shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for o, start, text, anchors, runs, common in zip(*batch.columns, strict=True):
                words, own = text.as_py().split(), anchors.values.to_numpy()
                known, split = (common.values.field(k).to_numpy() for k in ("anchor", "split"))
                order = np.argsort(known)
                known, split = known[order], split[order].astype(np.uint64)
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                is_common, split, n_windows = known[place] == own, split[place], runs.values.to_numpy()
                is_common, own, split = (np.repeat(x, n_windows) for x in (is_common, own.view(np.uint64), split))
                part = _rolling(word_codes(words), window, 0xA24BAED4963EE407) % split if split.max() > 1 else np.uint64(0)
                dealt = ((own ^ (part * _MIX)) * _MIX >> np.uint64(32)) % np.uint64(shards)
                shard = np.where(is_common, dealt.astype(np.int64), -1)
                first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                for a, b, s in zip(first.tolist(), [*first[1:].tolist(), len(shard)], shard[first].tolist(), strict=True):
                    if s >= 0:
                        out.append((s, o.as_py(), start.as_py() + a, b" ".join(words[a : b + window - 1]), b - a + window - 1))
            if out:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "o", "start", "words", "n"])

    return rows.select("o", "start", "words", "anchors", "runs", "common").mapInArrow(gives_back(cut), "shard int, o long, start int, words binary, n int")


class Shard:
    """The automaton of a shard's passages, given as (o, start, words).

    A word is two letters of two alphabets, so that no state of the automaton has more branches than an alphabet has letters
    and matches begin and end with words. Tiles stand so close that each window holds one.
    """

    def __init__(self, parts: list[tuple[int, int, bytes]], window: int):
        self.window, self.tile = window, max(1, 2 * window // 5)
        split = [words.split() for _, _, words in parts]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        base = max(1, int(len(numbers) ** 0.5) + 1)
        self.names = {w: chr(_FIRST + k // base) + chr(_FIRST + base + 1 + k % base) for w, k in numbers.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        text = "".join([self.names[w] for w in chain.from_iterable(split)])
        sizes = np.array([len(words) for words in split])
        begins = np.cumsum(sizes) - sizes
        for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
            for k in range(begin, begin + size - self.tile + 1, window - self.tile + 1):
                self.automaton.add_word(text[2 * k : 2 * (k + self.tile)])
        self.automaton.make_automaton()
        self.flat = self._row(text)
        part = np.repeat(np.arange(len(parts)), sizes)
        inside = np.arange(len(self.flat)) - begins[part]
        at = np.flatnonzero(inside + window <= sizes[part])
        codes = _rolling(self.flat, window, 0xA24BAED4963EE407)[at]
        order = np.argsort(codes, kind="stable")
        self.codes, self.at = codes[order], at[order]
        own = part[self.at]
        self.first_o = np.array([o for o, _, _ in parts])[own]
        self.first_start = np.array([start for _, start, _ in parts])[own] + inside[self.at]

    @staticmethod
    def _row(text: str) -> np.ndarray:
        """A number for each word of two letters."""
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return letters[::2] << np.uint64(32) | letters[1::2]

    def removed(self, rows: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, int]]:
        """(o, from, to) of windows of regions (o, start, words, number of words) that are passages' and not first places.

        The regions are streamed one after another; a window that lies in two of them is none.
        """
        window, tile, get = self.window, self.tile, self.names.get
        text = "".join([get(w, "\0\1") for w in b" ".join([words for _, _, words, _ in rows]).split()])
        ends = [end for end, _ in self.automaton.iter(text)]
        if not ends:
            return []
        o, start, sizes = (np.array([r[k] for r in rows]) for k in (0, 1, 3))
        begins, n = np.cumsum(sizes) - sizes, len(text) // 2 - window + 1
        begin = np.array(ends) // 2 - tile + 1
        low, high = np.clip(begin - (window - tile), 0, max(n, 0)), np.clip(begin + 1, 0, max(n, 0))
        at = np.flatnonzero(np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:-1] > 0) if n > 0 else np.zeros(0, int)
        row, region = self._row(text), np.searchsorted(begins, at, "right") - 1
        whole = at - begins[region] + window <= sizes[region]
        at, region = at[whole], region[whole]
        if not len(at):
            return []
        codes = _rolling(row, window, 0xA24BAED4963EE407)[at]
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[place] == codes
        at, region, place = at[known], region[known], place[known]
        within = np.arange(window)
        same = (row[at[:, None] + within] == self.flat[self.at[place][:, None] + within]).all(1)
        starts = start[region] + at - begins[region]
        gone = same & ((self.first_o[place] != o[region]) | (self.first_start[place] != starts))
        starts, region = starts[gone], region[gone]
        if not len(starts):
            return []
        split = np.flatnonzero((np.diff(starts) > window) | (np.diff(region) != 0))
        first, last = np.r_[0, split + 1], np.r_[split, len(starts) - 1]
        return list(zip(o[region[first]].tolist(), starts[first].tolist(), (starts[last] + window).tolist(), strict=True))


def _streamed(documents: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """(o, low, high): spans to remove, from regions (shard, chunk, o, start, words, n) and passages (shard, chunk, o, start, words)."""

    def stream(texts: pa.Table, own: pa.Table) -> pa.Table:
        spans: list[tuple[int, int, int]] = []
        if texts.num_rows and own.num_rows:
            shard = Shard(list(zip(*(own.column(c).to_pylist() for c in ("o", "start", "words")), strict=True)), window)
            for batch in texts.select(["o", "start", "words", "n"]).to_batches(max_chunksize=2000):
                spans += shard.removed(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
        return pa.table([pa.array([x[k] for x in spans], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["o", "low", "high"])

    keys = ["shard", "chunk"]
    return documents.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(stream, "o long, low int, high int")


def _places_of_windows(parts: int, rows: int, words: int) -> tuple[Callable, Callable, Callable]:
    """How a window's (o, start) becomes one value in the same order, and the way back to o and to start. ``o`` is a partition's
    number (under ``parts``) and a row's in it (under ``rows``); if all places fit one long, their minima need no sorting."""
    if parts * rows * words >= 1 << 63:
        return lambda o, start: F.struct(F.col(o).alias("o"), start.alias("start")), lambda f: F.col(f)["o"], lambda f: F.col(f)["start"]

    def place(o: str, start: Column) -> Column:
        return (F.shiftright(o, 33) * F.lit(rows) + F.col(o).bitwiseAND((1 << 33) - 1)) * F.lit(words) + start

    row = lambda f: F.expr(f"({f} div {words}L) % {rows}L")
    return place, lambda f: F.shiftleft(F.expr(f"{f} div {rows * words}L"), 33) + row(f), lambda f: F.expr(f"cast({f} % {words}L as int)")


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, t, copy, spans) of the documents that lose words; t is the hash of the text, copy: all words go."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    scanned = stored(anchor_table(hashed, window).filter(F.col("n_words") >= window), "anchors")
    order = ["doc_id", "h1", "h2"]
    ids = scanned.groupBy(*order).agg(F.min("t").alias("t"), F.max("n_words").alias("n_words"))
    ids = stored(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("o", F.monotonically_increasing_id()), "order")
    bounds = ids.agg(F.max(F.shiftright("o", 33)), F.max(F.col("o").bitwiseAND((1 << 33) - 1)), F.max("n_words")).first()
    heads = ids.groupBy("h1", "h2").agg(F.min(F.struct("o", "doc_id", "t")).alias("head"), F.count("*").alias("n"))
    heads = stored(heads.select("h1", "h2", "n", "head.*"), "first-of-class")
    words = F.struct("h1", "h2").alias("words")
    copies = salted_join(ids.select(words, *order, "o"), heads.filter("n > 1").select(words, F.col("o").alias("head"), "n"), "words", "o")
    copies = copies.filter("o != head").select(*order)
    own_row = lambda rows: (rows["doc_id"].eqNullSafe(F.col("i"))) & (rows["t"] == F.col("u"))
    first = heads.select("o", F.col("doc_id").alias("i"), F.col("t").alias("u"))
    firsts = stored(scanned.join(first, own_row(scanned)).select("o", "i", "u", "anchors"), "first-anchors")
    each = firsts.select("o", F.explode("anchors").alias("anchor"))
    counted = stored(each.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "recurring-anchors")
    hits = salted_join(each, counted, "anchor", "o").groupBy("o").agg(F.collect_set("anchor").alias("hits"))
    hits = stored(hits.join(first, "o"), "anchor-hits")
    discard(firsts)
    found = stored(regions(hashed.join(hits, own_row(hashed)), window), "regions")
    windows = found.select("o", F.posexplode(F.arrays_zip("h", "g")).alias("at", "w"), "start")
    place, place_o, place_start = _places_of_windows(*(1 + (x or 0) for x in bounds))
    windows = windows.select(F.col("w.h").alias("h"), F.col("w.g").alias("g"), place("o", F.col("start") + F.col("at")).alias("f"))
    confirmed = windows.groupBy("h", "g").agg(F.min("f").alias("f"), F.count("*").alias("n")).filter("n > 1")
    firsts = confirmed.select(place_o("f").alias("o"), place_start("f").alias("start"))
    starts = stored(firsts.groupBy("o").agg(F.collect_list("start").alias("starts")), "first-windows")
    inside = F.filter("starts", lambda s: (s >= F.col("start")) & (s <= F.col("start") + F.col("n") - window))
    here = found.join(starts, "o").select("o", "start", "words", "anchors", "runs", inside.alias("firsts")).filter(F.size("firsts") > 0)
    parts = stored(passages(here, window), "passages")
    shards = -(-(parts.agg(F.sum("n")).first()[0] or 1) // SHARD_WORDS)
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("o", F.floor(F.col("start") / (16 * _PART))), F.lit(shards)).cast("int"))
    homes = dealt.select("shard", F.explode(F.array_distinct("anchors")).alias("anchor")).groupBy("anchor")
    homes = homes.agg(F.min("shard").alias("shard"), F.max("shard").alias("last"), F.ceil(F.count("*") / COMMON_PASSAGES).alias("split"))
    homes = homes.select("anchor", F.when(F.col("shard") == F.col("last"), F.col("shard")).alias("shard"), "split")
    pieces = found.select("o", "start", F.explode(F.array_distinct("anchors")).alias("anchor"))
    held = stored(homes.join(pieces.groupBy("anchor").agg(F.count("*").alias("n")), "anchor"), "anchor-shards")
    common = F.when(F.col("shard").isNull(), F.struct("anchor", "split"))
    routes = salted_join(pieces, held, "anchor", "o").groupBy("o", "start")
    routes = stored(routes.agg(F.collect_set("shard").alias("shards"), F.collect_list(common).alias("common")), "routes")
    whole = found.select("o", "start", "words", "n").join(routes, ["o", "start"]).select(F.explode("shards").alias("shard"), "o", "start", "words", "n")
    commons = routes.filter(F.size("common") > 0).select("o", F.col("start").alias("region"), "common")
    under = found.withColumn("region", F.col("start")).join(commons, ["o", "region"])
    runs = stored(common_runs(under, window, shards), "common-runs")
    dealt = dealt.select(runs.columns).unionByName(common_runs(parts.join(commons, ["o", "region"]), window, shards))
    sent = whole.unionByName(runs)
    sizes = found.select("o", "start", "n").join(routes, ["o", "start"]).select("n", F.explode("shards").alias("shard")).unionByName(runs.select("n", "shard"))
    sizes = stored(sizes.groupBy("shard").agg(F.ceil(F.sum("n") / CHUNK_WORDS).cast("int").alias("chunks")), "shard-sizes")
    chunk = F.pmod(F.xxhash64("o", "start"), F.col("chunks")).cast("int").alias("chunk")
    sent = sent.join(F.broadcast(sizes) if shards <= BROADCAST_SHARDS else sizes, "shard").select("shard", chunk, "o", "start", "words", "n")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    own = dealt.join(sizes, "shard").select("shard", every, "o", "start", "words")
    tasks = 2 * (sizes.agg(F.sum("chunks")).first()[0] or 1)  # else a few tasks by bytes, unevenly loaded
    spans = _streamed(sent.repartition(tasks, "shard", "chunk"), own.repartition(tasks, "shard", "chunk"), window)
    spans = stored(spans.groupBy("o").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    for done in (found, starts, parts, held, routes, runs, counted):
        discard(done)
    cut = spans.join(ids, "o").select(*order, F.lit(False).alias("copy"), "spans")
    cut = cut.unionByName(copies.select(*order, F.lit(True).alias("copy"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    texts = scanned.select(*order, "t").distinct()
    same = texts["doc_id"].eqNullSafe(F.col("i")) & (texts["h1"] == F.col("g1")) & (texts["h2"] == F.col("g2"))
    renamed = cut.withColumnsRenamed({"doc_id": "i", "h1": "g1", "h2": "g2"})
    out = stored(texts.join(renamed, same).select("doc_id", "t", "copy", "spans"), "repeated-spans")
    for done in (scanned, ids, heads, hits, sizes, spans):
        discard(done)
    return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` as struct ``d``, with n_words, n_removed and kept (the words that stay, joined by one space)."""
    spans = repeated_spans(docs, window).withColumnsRenamed({"doc_id": "i", "t": "u"})
    whole = docs.select(F.struct("*").alias("d"))
    same = F.col("d.doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("d.text") == F.col("u"))
    joined = whole.join(spans, same, "left").select("d", F.col("d.text").alias("text"), "copy", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, copy, cuts in zip(*(batch.column(c) for c in ("text", "copy", "spans")), strict=True):
                words = words_of(text.as_py())
                stay = [] if copy.as_py() else words
                if cuts.is_valid:
                    gone = bytearray(len(words))
                    for cut in cuts.as_py():
                        gone[cut["low"] : cut["high"]] = b"\x01" * (cut["high"] - cut["low"])
                    stay = [w for w, x in zip(words, gone, strict=True) if not x]
                n_words.append(len(words))
                n_removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *made], ["d", "n_words", "n_removed", "kept"])

    schema = whole.schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return joined.mapInArrow(gives_back(remove), schema)


def substring_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    cut = dedup_substrings(docs.select("doc_id", "text"), window)
    return cut.select(F.col("d.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words that stay, joined by one space, where any went; other texts stay as they are."""
    cut = dedup_substrings(docs, window)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("d.text"))
    return cut.select(cut["d"].withField("text", text).alias("d")).select("d.*")
