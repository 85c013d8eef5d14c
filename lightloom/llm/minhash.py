"""MinHash near-dedup: universal hash minima with banding, signature verification, full-set confirmation, components.

1. A text becomes the set of its word shingles (64-bit codes), a 128-bit digest of the set and ``MINIMA`` minima of
   universal (multiply-shift) hashes. Equal sets are one class from here on; its smallest doc_id stands for it.
2. Classes that agree in one of ``BANDS`` bands of minima share a bucket. A bucket of up to ``SMALL`` classes gives all its
   pairs. A larger one gives a star: each class with the centre, the class whose buckets are the fullest in all (in a
   family of near copies that is the text which the others were made from), so rows stay in proportion to classes.
3. Pairs whose signatures agree too little go; the others are confirmed on the full sets of the two texts.
4. Large buckets are completed exactly: their classes that are not in their centre's component yet are held against all
   classes around that centre on full sets, in blocks, without a row for each pair.
5. Components by alternating large-star and small-star.

Banding misses a pair at the threshold of 0.85 with a probability of 2e-8 (0.8: 3e-6).

Defined results: a text of fewer words than a shingle has one shingle, all its words; texts without words (or null) have
none and link with nothing; rows that share a doc_id count as one document; a null doc_id links with nothing, has a null
component and is kept; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, salted_join, stored
from .graph import connected_components

MINIMA, ROWS = 96, 4
BANDS = MINIMA // ROWS
SMALL = 32
MARGIN = 0.2
BLOCK_SHINGLES = 60_000
BROADCAST_IDS = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Codes(dict):
    """Words to 64-bit codes."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


class Shingler:
    """Texts to sorted arrays of distinct shingle codes."""

    def __init__(self, width: int):
        self.width = width
        self.codes = _Codes()
        self.odd = [np.uint64(xxhash.xxh3_64_intdigest(b"shingle %d" % k) | 1) for k in range(width)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64)
        if len(self.codes) > 120_000:
            self.codes.clear()
        codes = np.array(list(map(self.codes.__getitem__, words)), np.uint64)
        n = len(codes) - self.width + 1
        total = codes[:n] * self.odd[0]
        for k in range(1, self.width):
            total += codes[k : k + n] * self.odd[k]
        total ^= total >> np.uint64(29)
        return np.unique(total)


def _universal() -> list[tuple[np.uint64, np.uint64]]:
    seed = lambda name, k: xxhash.xxh3_64_intdigest(b"%s %d" % (name, k))
    return [(np.uint64(seed(b"a", k) | 1), np.uint64(seed(b"b", k))) for k in range(MINIMA)]


def _minima(sets: list[np.ndarray], functions: list) -> np.ndarray:
    """uint32 [sets, MINIMA]; rows of empty sets are 0."""
    out = np.zeros((len(sets), MINIMA), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[k] for k in full])
    starts = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
    work = np.empty_like(flat)
    for f, (a, b) in enumerate(functions):
        np.multiply(flat, a, out=work)
        work += b
        out[full, f] = np.minimum.reduceat(work, starts) >> np.uint64(32)
    return out


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, functions = Shingler(width), _universal()
        names = ["doc_id", "n_shingles", "h1", "h2", "sig"]

        def rows(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            digests = np.array([divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) for s in sets], np.uint64).view(np.int64)
            minima = [m.tobytes() for m in _minima(sets, functions)]
            columns = [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(minima, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                sets.append(shingle(text.as_py()))
                held += len(sets[-1])
                if held > 60_000:
                    yield rows(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield rows(ids, sets)

    return docs.select("doc_id", "text").mapInArrow(gives_back(sign), SIGNATURE_SCHEMA)


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Signature verification: pairs whose minima agree in at least that share."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA) for c in ("sa", "sb"))
            yield batch.filter(pa.array((x == y).mean(1) >= least)).select(["a", "b"])

    side = lambda n: reps.select(F.col("rep").alias(n), F.col("sig").alias("s" + n))
    return _beside(pairs, side).mapInArrow(gives_back(compare), "a long, b long")


def _beside(pairs: DataFrame, side: Callable[[str], DataFrame]) -> DataFrame:
    """Stored pairs with what ``side`` has for a and for b; the centre of a large star is in very many of them."""
    out = pairs
    for n, other in (("a", "b"), ("b", "a")):
        out = salted_join(out, side(n).join(pairs.groupBy(n).agg(F.count("*").alias("n")), n), n, other)
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of these ids. Up to ``BROADCAST_IDS`` ids, counted here, go to every task; more are joined."""
    ids = stored(ids.distinct(), "text-ids")
    few = ids.count() <= BROADCAST_IDS
    return stored(docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "texts")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, own = Shingler(width), None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if b != last:
                    last, own = b, shingle(tb.as_py())
                other = shingle(ta.as_py())
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    side = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias("t" + n))
    return _beside(pairs, side).mapInArrow(gives_back(confirm), "a long, b long")


def _candidates(members: DataFrame) -> DataFrame:
    """From (key, rep, n, centre): pairs (a, b), all of small buckets, a star of large ones."""
    small = members.filter(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("rep")).alias("m"))
    later = lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.a", "p.b")
    star = members.filter((F.col("n") > SMALL) & (F.col("rep") != F.col("centre"))).select(*_pair("rep", "centre"))
    return pairs.unionByName(star).distinct()


def _linked_across(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between (rep, root, set) of both sides with different roots, one for each rep and other root."""
    codes = np.concatenate([r[2] for r in right])
    owners = np.repeat(np.arange(len(right)), [len(r[2]) for r in right])
    order = np.argsort(codes, kind="stable")
    codes, owners = codes[order], owners[order]
    sizes, roots = np.array([len(r[2]) for r in right]), np.array([r[1] for r in right])
    out = []
    for rep, root, own in left:
        first, last = np.searchsorted(codes, own, "left"), np.searchsorted(codes, own, "right")
        count = last - first
        ends = np.cumsum(count)
        at = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
        both = np.bincount(owners[at], minlength=len(right))
        linked = np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (both > 0) & (roots != root))
        out += [(rep, right[k][0]) for k in linked[np.unique(roots[linked], return_index=True)[1]]]
    return out


def _completion(members: DataFrame, sizes: DataFrame, roots: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that the stars of large buckets missed: all classes of a family (the large buckets with one centre) that are
    not in the centre's component are held against the whole family on full sets, block by block. No row is made for a
    pair, blocks have about ``BLOCK_SHINGLES`` shingles, and a large family is many blocks."""
    large = members.filter(F.col("n") > SMALL).select("centre", "rep").distinct()
    root = roots.select(F.col("node").alias("rep"), "root")
    centre = roots.select(F.col("node").alias("centre"), F.col("root").alias("centre_root"))
    placed = large.join(root, "rep", "left").join(centre, "centre", "left").join(sizes, "rep")
    placed = placed.select("centre", "rep", "size", F.coalesce("root", "rep").alias("root"), (F.coalesce("root", "rep") != F.coalesce("centre_root", "centre")).alias("open"))
    placed = stored(placed, "families")
    blocks = F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks")
    family = placed.groupBy("centre").agg(blocks, F.max("open").alias("any_open")).filter("any_open").select("centre", "blocks")
    dealt = placed.join(family, "centre").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = dealt.filter("open").select("centre", F.col("block").alias("i"), every.alias("j"), "rep", "root", F.lit(True).alias("left"))
    cells = cells.unionByName(dealt.select("centre", every.alias("i"), F.col("block").alias("j"), "rep", "root", F.lit(False).alias("left")))
    texts = _texts(docs, dealt.select(F.col("rep").alias("doc_id")))
    filled = cells.join(texts, F.col("rep") == F.col("doc_id")).select("centre", "i", "j", "rep", "root", "left", "text")

    def compare(cell: pa.Table) -> pa.Table:
        shingle = Shingler(width)
        sides: tuple[list, list] = ([], [])
        for rep, root, left, text in zip(*(cell.column(c).to_pylist() for c in ("rep", "root", "left", "text")), strict=True):
            sides[not left].append((rep, root, shingle(text)))
        links = _linked_across(*sides, percent) if all(sides) else []
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return filled.groupBy("centre", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    signed = stored(signatures(docs, width), "minhash")
    usable = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    same = usable.withColumnRenamed("doc_id", "rep").select("rep", "h1", "h2", "sig").dropDuplicates(["rep", "h1", "h2"])
    reps = stored(same.join(classes, ["rep", "h1", "h2"], "left_semi").select("rep", "sig"), "classes")

    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring(sig, k * {4 * ROWS} + 1, {4 * ROWS})))")
    keyed = reps.select("rep", F.explode(bands).alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(shared, "shared-keys")
    held = salted_join(keyed, shared.withColumn("size", F.col("n")), "key", "rep").withColumnRenamed("size", "n")
    sized = stored(held.select("key", "rep", "n"), "buckets")
    fullness = sized.groupBy("rep").agg(F.sum("n").alias("full"))
    centres = (
        sized.filter(F.col("n") > SMALL)
        .join(fullness, "rep")
        .groupBy("key")
        .agg((-F.max(F.struct("full", (-F.col("rep")).alias("by")))["by"]).alias("centre"))
    )
    large = salted_join(sized.filter(F.col("n") > SMALL), shared.join(centres, "key"), "key", "rep")
    small = sized.filter(F.col("n") <= SMALL).withColumn("centre", F.lit(None).cast("long"))
    members = stored(small.unionByName(large.select(*small.columns)), "members")
    pairs = _agreeing(stored(_candidates(members), "candidates"), reps, percent / 100 - MARGIN)
    links = stored(_confirmed(stored(pairs, "pairs"), docs, width, percent), "links")
    several = usable.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("kinds")).filter("kinds > 1").select("doc_id")
    one_document = usable.join(several, "doc_id").join(classes, ["h1", "h2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(one_document))
    if not members.filter(F.col("n") > SMALL).isEmpty():
        sizes = usable.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size")).groupBy("rep").agg(F.max("size").alias("size"))
        extra = stored(_completion(members, sizes, roots, docs, width, percent), "links")
        if not extra.isEmpty():
            known = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = connected_components(known.unionByName(extra.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    digest = F.struct("h1", "h2").alias("set")
    in_class = classes.join(roots, F.col("rep") == F.col("node"), "left").select(digest, F.coalesce("root", "rep").alias("component_id"), "n")
    placed = salted_join(usable.select("doc_id", "n_shingles", digest), in_class, "set", "doc_id").drop("set")
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def minhash_report(docs: DataFrame, width: int, percent: int) -> DataFrame:
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return near_duplicates(docs, width, percent).withColumn("kept", kept)


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row for each group of near copies: the smallest doc_id's. Texts without words all stay."""
    gone = near_duplicates(docs, width, percent).filter("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    whole = docs.select(F.struct("*").alias("d"))
    kept = whole.join(gone, F.col("d.doc_id") == F.col("gone"), "left_anti")
    twice = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("twice"))
    if not twice.isEmpty():  # rows that share an id are one document
        repeated = F.col("d.doc_id") == F.col("twice")
        one = kept.join(twice, repeated, "left_semi").withColumn("id_", F.col("d.doc_id")).dropDuplicates(["id_"]).select("d")
        kept = kept.join(twice, repeated, "left_anti").unionByName(one)
    return kept.select("d.*")
