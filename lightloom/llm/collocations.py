"""Phrase collocations by dynamic itemset counting.

Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A phrase is
up to ``longest`` consecutive words of a piece; everything is counted per language.

Texts are dealt to ``shards`` by hash, and the shards are scanned in turn, again and again. Words are active from the first scan
on. A phrase of more words becomes active as soon as the phrases without its first and without its last word have both been
found ``least`` times, which may be in the middle of a cycle, and is then counted in as many consecutive scans as there are
shards: one full cycle, after which its count is exact. Lengths are so counted side by side. The scans end when no phrase is
active any more. What reaches ``least`` in all has parts that reach it, so no frequent phrase is missed.

1. Once, words become 64-bit codes of (language, word): a shard is stored as blocks of codes, 0 between pieces, beside the words
   themselves. Should a frequent word share its code with another word, all is done again with other codes.
2. Once, all pairs are counted by hash in up to 2^``MOST_BITS`` buckets. A pair whose bucket stays below ``least`` over all texts
   stays below it as well, so tasks leave it out; what is left is counted by its codes.
3. A scan is one job. Tasks keep the phrases whose two parts are in a bitmap of the phrases found so far (and one of both in that
   of the last cycle: the others are complete), sum them up, and Spark adds them, with the counts of the last scans, by their
   codes. The bitmaps have at most 2^``MOST_BITS`` bits; what they let through too much is told by joins of the few phrases that
   come to ``least`` with those found: only the scans from a phrase's activation on count.
4. In the end codes become words again, and phrases are scored.

Defined results: a null text has no words; a null language counts as ``und``; a language without a frequent phrase has no
rows; repeated rows count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, gives_back, stored

LEAST = 100
LONGEST = 5
SHARDS = 2
TOP = 2000
MOST_BITS = 28
#: Words of a block of codes; phrases that a task holds before it gives them out; words whose codes it remembers.
BLOCK_WORDS = 30_000
HELD = 150_000
REMEMBERED = 100_000
SALTS = 32
#: Phrases in one batch that a task gives out.
GIVEN = 20_000
#: Hashes of pairs that a task holds before it gives out their buckets; places that the smallest number of buckets has in each.
HELD_PAIRS = 500_000
PAIRS_A_BUCKET = 4
#: Words in one row, between line ends, which no word has.
NAMES = 10_000
#: Blocks of codes are long rows: about so many bytes go to a Python worker at a time.
BATCH_BYTES = 1 << 20
#: Readers take a page and a row group at once: Parquet looks at their sizes after 4 rows instead of 100.
LONG_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "4"}
#: A-Z to a-z, what ends a piece to ``.``, a tab to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else (46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b) for b in range(256))
#: Bits of a block that Spark's bitmap functions build.
_BLOCK_BITS = 15
_SEEDS = [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % k) | 1) for k in range(8)]
_SPARK_SEED = 42
_CODED = "shard int, codes binary, lang string, word string, words long"
#: The shard of the rows that have words instead of codes.
_NAMES = -1


def word_code(lang: Column, word: Column, salt: int) -> Column:
    """The code of a word; 0 stands between pieces."""
    code = F.xxhash64(F.lit(str(salt)), lang, word)
    return F.when(code == 0, F.lit(1).cast("long")).otherwise(code)


class _Codes(dict):
    """Words of one language to the codes of ``word_code``."""

    def __init__(self, lang: str, salt: int):
        super().__init__({b".": 0})
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest(str(salt), _SPARK_SEED))

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        return code


def _slices(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of a long text, each ended by a space or the end of the text."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= most else text.find(b" ", at + most) + 1 or len(text)
        yield text[at:end]
        at = end


def coded(texts: DataFrame, salt: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """From (lang, text, shard) the rows of ``_CODED``: blocks of codes of each shard, in which a text stays whole unless it is
    longer than a block (then the next block begins with the last words of the one before, marked by its ``words``), and in
    shard ``_NAMES`` the words, many in a row, and how many there were of a language."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held, sizes, totals = {}, {}, {}, {}

        def rows(shard: int, blocks: list, langs: list, words: list, counts: list) -> pa.RecordBatch:
            n = len(blocks)
            columns = [pa.array([shard] * n, pa.int32()), pa.array(blocks, pa.binary()), pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "codes", "lang", "word", "words"])

        def block(shard: int, again: int = 0) -> pa.RecordBatch:
            """The block at hand; the next one has its last ``again`` codes once more."""
            flat, told = np.concatenate(held[shard]), first.pop(shard, 0)
            held[shard], sizes[shard] = ([flat[-again:]], again) if again else ([], 0)
            if again:
                first[shard] = again
            return rows(shard, [flat.tobytes()], [None], [None], [told])

        def names() -> Iterator[pa.RecordBatch]:
            for lang, own in codes.items():
                words = [w for w in own if w != b"."]
                for a in range(0, len(words), NAMES):
                    yield rows(_NAMES, [None], [lang], [b"\n".join(words[a : a + NAMES])], [0])
                yield rows(_NAMES, [None], [lang], [None], [totals.pop(lang, 0)])
            codes.clear()

        first: dict[int, int] = {}
        for batch in batches:
            for lang, text, shard in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if not text.is_valid:
                    continue
                if lang not in codes:
                    codes[lang] = _Codes(lang, salt)
                own = codes[lang]
                for part in _slices(text.as_py().encode("utf-8", "surrogatepass").translate(_TABLE).replace(b".", b" . "), 16 * block_words):
                    if sizes.get(shard, 0) >= 2 * block_words:
                        yield block(shard, LONGEST - 1)
                    tokens = part.split()
                    made = np.fromiter(map(own.__getitem__, tokens), np.uint64, len(tokens))
                    held.setdefault(shard, []).append(made)
                    sizes[shard] = sizes.get(shard, 0) + len(made)
                    totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(made))
                if shard in held:
                    held[shard].append(np.zeros(1, np.uint64))
                if sizes.get(shard, 0) >= block_words:
                    yield block(shard)
                if sum(map(len, codes.values())) > REMEMBERED:
                    yield from names()
        for shard in held:
            if sizes[shard]:
                yield block(shard)
        yield from names()

    return texts.select("lang", "text", "shard").mapInArrow(gives_back(code), _CODED)


def _mixed(codes: np.ndarray, first: int, n: int, size: int) -> np.ndarray:
    """Hashes of the phrases of n words that begin at ``first`` and after it, ``size`` of them."""
    total = codes[first : first + size] * _SEEDS[0]
    for k in range(1, n):
        total += codes[first + k : first + k + size] * _SEEDS[k]
    total ^= total >> np.uint64(31)
    total *= _SEEDS[7]
    return total ^ (total >> np.uint64(29))


class Found:
    """Bitmaps of phrases, all found so far and those of the last cycle, and the lengths of the latter; if pairs are to be counted,
    the bitmap of ``_pair_buckets``."""

    def __init__(self, bits: int, every: np.ndarray, recent: np.ndarray, lengths: list[int], pairs: np.ndarray | None = None):
        self.shift, self.every, self.recent, self.lengths, self.pairs = np.uint64(64 - bits), every, recent, lengths, pairs

    def _has(self, bitmap: np.ndarray, hashes: np.ndarray, shift: np.uint64 | None = None) -> np.ndarray:
        at = hashes >> (self.shift if shift is None else shift)
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def both(self, parts: np.ndarray) -> np.ndarray:
        """For hashes of parts, one for each place: places where the phrase of two neighbouring ones is to be counted."""
        known = self._has(self.every, parts)
        at = np.flatnonzero(known[:-1] & known[1:])
        return at[self._has(self.recent, parts[at]) | self._has(self.recent, parts[at + 1])]

    def often(self, pairs: np.ndarray) -> np.ndarray:
        """For hashes of pairs: which may come to the limit."""
        return self._has(self.pairs, pairs, np.uint64(65 - (8 * len(self.pairs)).bit_length()))


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``words`` with their summed counts."""
    n = words.shape[1]
    hashes = words[:, 0] if n == 1 else _mixed(words.ravel(), 0, n, words.size - n + 1)[::n]
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    own = words[first]
    if n > 1 and not (own[which] == words).all():  # two phrases of one hash
        own, which = np.unique(words, axis=0, return_inverse=True)
        which = which.ravel()
    return own, np.bincount(which, counts, len(own)).astype(np.int64)


class _Counter:
    """Counts of phrases by their codes."""

    def __init__(self, words: bool, found: Found | None, longest: int):
        self.found = found
        self.lengths = [1] * words + [n for n in range(2, longest + 1) if found is not None and n - 1 in found.lengths]
        self.held: dict[int, list] = {n: [] for n in self.lengths}
        self.size, self.ripe = 0, HELD

    def add(self, codes: np.ndarray, again: int) -> None:
        """Count a block; of what its first ``again`` words begin only phrases that go beyond them."""
        padded = np.r_[codes, np.zeros(LONGEST, np.uint64)]
        word, total = padded != 0, len(codes)
        for n in self.lengths:
            if n == 1:
                at = np.flatnonzero(word[:total])
            else:
                at = self.found.both(_mixed(padded, 0, n - 1, total + 1))
                if n == 2 and self.found.pairs is not None:
                    at = at[self.found.often(_mixed(padded, 0, 2, total)[at])]
                for k in range(n):
                    at = at[word[at + k]]
            at = at[at + n > again]
            if len(at):
                own, counts = _summed(padded[at[:, None] + np.arange(n)], np.ones(len(at)))
                self.held[n].append((own, counts))
                self.size += len(counts)
        if self.size > self.ripe:
            for n, parts in self.held.items():
                if len(parts) > 1:
                    self.held[n] = [_summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            self.size = sum(len(p[1]) for parts in self.held.values() for p in parts)
            self.ripe = HELD if self.size > HELD // 2 else 2 * HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was counted since the last call."""
        for n, parts in self.held.items():
            if parts:
                words, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                for a in range(0, len(counts), GIVEN):
                    own = np.zeros((min(GIVEN, len(counts) - a), LONGEST), np.uint64)
                    own[:, :n] = words[a : a + GIVEN]
                    columns = [pa.array(np.ascontiguousarray(own[:, k]).view(np.int64)) for k in range(LONGEST)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[a : a + GIVEN])], [*WORDS, "count"])
        self.held, self.size = {n: [] for n in self.lengths}, 0


WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


def phrase_counts(blocks: DataFrame, words: bool, found: object | None, longest: int = LONGEST) -> DataFrame:
    """(w1 to w5, count) by task: of words if ``words``, of longer phrases as ``found`` (a broadcast ``Found``) lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(words, None if found is None else found.value, longest)
        for batch in batches:
            for codes, again in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counter.add(np.frombuffer(codes.as_buffer(), np.uint64), again)
                if counter.size > HELD:
                    yield from counter.rows()
        yield from counter.rows()

    return blocks.select("codes", "words").mapInArrow(gives_back(count), ", ".join(f"{w} long" for w in WORDS) + ", count long")


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all values, then the next ones: most are 0 above, which a shuffle packs."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _of_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pair_buckets(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bitmap of 2^bits buckets of hashes of pairs: those with ``least`` places or more in all texts. A task gives out, for each
    block of buckets, the distances of those it has met and their counts; Spark brings the blocks together."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def blocks() -> pa.RecordBatch:
            at, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = np.minimum(counts, least).astype(np.int32)  # a sum of what is cut off here has come to the limit
            starts = np.flatnonzero(np.diff(at >> _BLOCK_BITS, prepend=-1))
            steps = np.diff(at, prepend=0)
            steps[starts] = at[starts] & ((1 << _BLOCK_BITS) - 1)
            steps = steps.astype(np.uint16)
            cuts = list(zip(starts, [*starts[1:], len(at)], strict=True))
            columns = [pa.array(at[starts] >> _BLOCK_BITS), *[pa.array([_planes(x[a:b]) for a, b in cuts], pa.binary()) for x in (steps, counts)]]
            return pa.RecordBatch.from_arrays(columns, ["block", "steps", "counts"])

        for batch in batches:
            for codes, again in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(codes.as_buffer(), np.uint64)[max(0, again - 1) :]
                if len(own) > 1:
                    pair = (own[:-1] != 0) & (own[1:] != 0)
                    held.append((_mixed(own, 0, 2, len(own) - 1)[pair] >> np.uint64(64 - bits)).astype(np.int32))
                    size += len(held[-1])
                if size > HELD_PAIRS:
                    yield blocks()
                    held, size = [], 0
        if size:
            yield blocks()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, steps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block not in totals:
                    totals[block] = np.zeros(1 << _BLOCK_BITS, np.int32)
                own, at = totals[block], np.cumsum(_of_planes(steps, np.uint16), dtype=np.int64)
                own[at] = np.minimum(own[at] + _of_planes(counts, np.int32), least)
        often = {block: own >= least for block, own in totals.items()}
        often = {block: np.packbits(own, bitorder="little").tobytes() for block, own in often.items() if own.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(often), pa.int32()), pa.array(list(often.values()), pa.binary())], ["block", "often"])

    texts = rows.filter(F.col("shard") >= 0).select("codes", "words")
    blocks = texts.mapInArrow(gives_back(met), "block int, steps binary, counts binary").repartition("block")
    out, size = np.zeros((1 << bits) >> 3, np.uint8), 1 << (_BLOCK_BITS - 3)
    for r in blocks.mapInArrow(gives_back(summed), "block int, often binary").collect():  # at most 2^(bits - 15), of 4096 bytes
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(bytes(r.often), np.uint8)
    return out


def _bitmaps(found: DataFrame, since: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of 2^bits bits of the hashes of all phrases, and of those reached ``since``, put together by Spark from blocks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(w).to_numpy(zero_copy_only=False) for w in WORDS]).view(np.uint64)
            sizes, at = (words != 0).sum(0), np.zeros(batch.num_rows, np.int64)
            for n in range(1, LONGEST + 1):
                own = np.flatnonzero(sizes == n)
                if len(own):
                    flat = np.ascontiguousarray(words[:n, own].T).ravel()
                    at[own] = (_mixed(flat, 0, n, len(flat) - n + 1)[::n] >> np.uint64(64 - bits)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("recent")], ["at", "recent"])

    at = found.select(*WORDS, (F.col("reached") >= since).alias("recent")).mapInArrow(gives_back(places), "at long, recent boolean")
    low = F.col("at").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))
    blocks = at.groupBy(F.shiftright("at", _BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(low).alias("every"), F.bitmap_construct_agg(F.when(F.col("recent"), low)).alias("recent"))
    out = [np.zeros((1 << bits) >> 3, np.uint8) for _ in range(2)]
    size = 1 << (_BLOCK_BITS - 3)
    for block in blocks.collect():  # at most 2^(bits - 15), of two bitmaps of 4096 bytes
        for bitmap, own in zip(out, (block.every, block.recent), strict=True):
            bitmap[block.block * size : (block.block + 1) * size] = np.frombuffer(bytes(own), np.uint8)
    return out[0], out[1]


def _length() -> Column:
    return sum(((F.col(w) != 0).cast("int") for w in WORDS[1:]), F.lit(1))


def _told(run: DataFrame, found: DataFrame | None, step: int, shards: int, least: int) -> DataFrame:
    """Of the phrases whose counts of the last cycle come to ``least``: w1 to w5, n, since (the scan they are active from) and
    count (of the scans since then), where that is ``least`` or more."""
    ages = [F.col(f"c{k}") for k in range(shards)]
    large = run.filter(sum(ages[1:], ages[0]) >= least).withColumn("n", _length())
    words = large.filter("n = 1").withColumn("since", F.lit(0))
    if found is None:
        every = words
    else:
        zero = F.lit(0).cast("long")
        own = {f"h{k}": F.when(F.col("n") > k, F.col(w)).otherwise(zero) for k, w in enumerate(WORDS, 1)}
        own |= {f"t{k}": F.col(w) for k, w in enumerate(WORDS[1:], 1)} | {f"t{LONGEST}": zero}
        longer = large.filter("n > 1").withColumns(own)
        side = lambda x: found.select(*[F.col(w).alias(f"{x}{k}") for k, w in enumerate(WORDS, 1)], F.col("reached").alias(f"{x}_at"))
        for x in "ht":
            longer = longer.join(side(x), [f"{x}{k}" for k in range(1, LONGEST + 1)])
        every = words.unionByName(longer.withColumn("since", F.greatest("h_at", "t_at") + 1).select(*words.columns))
    count = sum((F.when(step - k >= F.col("since"), c).otherwise(0) for k, c in enumerate(ages)), F.lit(0))
    active = every.filter((F.col("since") <= step) & (F.col("since") > step - shards))
    return active.select(*WORDS, "n", "since", count.cast("long").alias("count")).filter(F.col("count") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, count) of all phrases of at least ``least`` places, and (lang, words): how many words there are."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shard = F.pmod(F.xxhash64("text", "doc_id"), F.lit(shards)).cast("int")
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", shard.alias("shard"))
    rows = stored(coded(dealt, salt).sortWithinPartitions("shard"), "phrase-codes", **LONG_ROWS)  # a scan skips other shards' pages
    words = rows.filter(F.col("shard") == _NAMES).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    pairs = _pair_buckets(rows, least, min(MOST_BITS, max(_BLOCK_BITS + 1, (words // PAIRS_A_BUCKET).bit_length())))
    run, found, final, step = None, None, None, 0
    while True:
        known, lengths = None, []
        if found is not None:
            recent = F.coalesce(F.max("reached") >= step - shards, F.lit(False)).alias("recent")
            sizes = found.groupBy("n").agg(F.count("*").alias("phrases"), recent).collect()  # a row for each length
            lengths = sorted(r.n for r in sizes if r.recent and r.n < longest)
            if lengths:
                bits = min(MOST_BITS, max(_BLOCK_BITS + 1, math.ceil(math.log2(sum(r.phrases for r in sizes))) + 5))
                known = spark.sparkContext.broadcast(Found(bits, *_bitmaps(found, step - shards, bits), lengths, pairs if 1 in lengths else None))
        if step >= shards and not lengths:
            break
        counted = phrase_counts(rows.filter(F.col("shard") == step % shards), step < shards, known, longest)
        zero = F.lit(0).cast("long")
        both = counted.select(*WORDS, F.col("count").alias("c0"), *[zero.alias(f"c{k}") for k in range(1, shards)])
        if run is not None and shards > 1:
            older = run.filter(" + ".join(f"c{k}" for k in range(shards - 1)) + " > 0")
            both = both.unionByName(older.select(*WORDS, zero.alias("c0"), *[F.col(f"c{k - 1}").alias(f"c{k}") for k in range(1, shards)]))
        former, run = run, stored(both.groupBy(*WORDS).agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(shards)]), "phrase-run")
        told = stored(_told(run, found, step, shards, least), "phrase-told")
        fresh = told if found is None else told.join(found, WORDS, "left_anti")
        fresh = fresh.select(*WORDS, "n", F.lit(step).alias("reached"))
        complete = told.filter(F.col("since") == step - shards + 1).select(*WORDS, "n", "count")
        found = stored(fresh if found is None else found.unionByName(fresh), "phrase-found")
        final = complete if final is None else final.unionByName(complete)
        if former is not None:
            discard(former)
        if known is not None:
            known.destroy()
        step += 1
    return _named(docs, stored(final, "phrase-final"), rows, least, longest, shards, salt)


def _named(docs: DataFrame, final: DataFrame, rows: DataFrame, least: int, longest: int, shards: int, salt: int) -> tuple[DataFrame, DataFrame]:
    """Codes to words, unless two words have the same."""
    words = rows.filter(F.col("shard") == _NAMES)
    totals = stored(words.filter("word is null").groupBy("lang").agg(F.sum("words").alias("words")), "phrase-totals")
    wanted = final.filter("n = 1").select(F.col("w1").alias("code"))
    words = words.filter("word is not null").select("lang", F.explode(F.split("word", "\n", -1)).alias("word"))
    every = words.select(word_code(F.col("lang"), F.col("word"), salt).alias("code"), "lang", "word")
    names = stored(every.join(wanted, "code").distinct(), "phrase-words")
    discard(rows)
    if not names.groupBy("code").count().filter("count > 1").isEmpty():
        return frequent_phrases(docs, least, longest, shards, salt + 1)
    phrases = final
    for k, w in enumerate(WORDS):
        own = names.select(F.col("code").alias(w), F.col("word").alias(f"s{k}"), *["lang"] * (k == 0))
        phrases = phrases.join(own, w, "inner" if k == 0 else "left")
    text = F.concat_ws(" ", *[F.col(f"s{k}") for k in range(LONGEST)])
    return phrases.select("lang", "n", text.alias("phrase"), "count"), totals


def _scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with the lowest-scoring cut: lang, phrase, length, score, k, l, r, a, n. All products are exact decimals."""
    longer = frequent.filter("n > 1").select("lang", "phrase", F.col("n").alias("length"), F.col("count").alias("a"))
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - length)")})
    side = lambda name, c: frequent.select("lang", F.col("phrase").alias(name), F.col("count").alias(c))
    met = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(totals.withColumnRenamed("words", "total"), "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    above = (exact("a") * exact("total")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    score = F.call_function("div", above.cast("decimal(38,0)"), (exact("l") * exact("r")).cast("decimal(38,0)"))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r", "a", F.col("total").alias("n"))).alias("b")
    return met.groupBy("lang", "phrase", "length").agg(lowest).select("lang", "phrase", "length", "b.*")


def _inside_longer(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, most): phrases inside longer frequent ones, with the largest count of those."""
    spans = F.explode(F.expr("flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> concat_ws(' ', slice(w, i, m)))))"))
    inner = frequent.filter("n > 2").select("lang", "n", "count", F.split("phrase", " ").alias("w")).select("lang", "count", spans.alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("count").alias("most"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language that no longer one of the same count holds."""
    frequent, totals = frequent_phrases(docs, least, longest, shards)
    frequent = stored(frequent, "phrases")
    kept = _scored(frequent, totals).join(_inside_longer(frequent), ["lang", "phrase"], "left").filter("most is null or most < a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
