"""Embedding near-dedup: iterative quantisation to balanced binary codes, multi-index Hamming tables, exact rerank.

Equal vectors are one class (its smallest vec_id stands for it, with a count). A rotation of the principal components
is learnt on at most ``SAMPLE`` classes, picked by hash, so that the signs of a vector's rotated coordinates keep angles;
every class is then coded. A code is cut into chunks of ``CHUNK`` bits, one table each; a query looks up its own chunk and
all chunks that differ in one bit, and what it meets within a limit of bits in the first code is reranked by the cosine of
the original vectors in double precision, so no pair below the threshold is linked. A slot with many candidates is compared
in blocks that give a star for each component they hold; links are then counted inside the components, block by block.
Rows grow with the number of classes, never with the pairs of a family of copies or near copies.

Pairs are found unless every chunk differs in two bits or more. How often that happens depends on the vectors: codes are
of vectors less their mean, so what all vectors share makes links look far apart. Pairs made at exactly the threshold, from
the sample, tell how many codes (each of another rotation, ``CODES``) find ``RECALL`` of them, and the limit of bits is the
largest distance among them. Where the most codes do not do, all classes are compared, block by block: exact, but its work
grows with the square of the classes.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with nothing (n_links 0,
component their own id); shorter vectors count as padded with zeros; rows that share a vec_id and a vector count as
two vectors; a null vec_id links with nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, salted_join, stored
from .graph import connected_components

SAMPLE = 10_000
ROUNDS = 50
BITS, CHUNK = 64, 16
#: Codes a vector has, in the order of trial; the share of made pairs to find; made pairs of each kind; classes in a block.
CODES = (1, 2, 4, 8, 16)
RECALL = 0.95
MADE = 2_000
BLOCK = 2_000
#: A slot with more pairs of a vector and a query than this is compared in blocks.
LARGE = 4_096


def _usable(embedding: str = "embedding") -> F.Column:
    e = F.col(embedding)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & fine & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Unit rows, in double precision."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), wide))
    out[np.arange(wide) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(1, keepdims=True, initial=1e-300)  # no overflow in the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the projection's columns are the rotated principal directions."""
    mean = sample.mean(0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    directions = vectors[:, ::-1][:, :bits]
    reduced = centred @ directions
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(directions.shape[1],) * 2))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(reduced @ rotation >= 0, 1.0, -1.0).T @ reduced)
        rotation = (left @ right).T
    return mean, directions @ rotation


def _signs(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return (unit - mean) @ projection >= 0


def pairs_at(sample: np.ndarray, threshold: float, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors with a cosine of ``threshold``: sample vectors moved any way, and the way that two others differ."""
    rng, made = np.random.default_rng(seed), []
    one, a, b = rng.integers(0, len(sample), (3, MADE))
    for way in (rng.normal(size=(MADE, sample.shape[1])), sample[a] - sample[b]):
        x = sample[one]
        way = way - np.einsum("ij,ij->i", way, x)[:, None] * x
        size = np.linalg.norm(way, axis=1)
        fine = size > 1e-9
        made.append((x[fine], threshold * x[fine] + np.sqrt(max(0.0, 1 - threshold**2)) * way[fine] / size[fine, None]))
    return [m for m in made if len(m[0])]


def choose_codes(sample: np.ndarray, bits: int, threshold: float) -> tuple[np.ndarray, list[np.ndarray], int] | None:
    """(mean, projections, limit of bits) that find ``RECALL`` of each kind of made pairs; None if the most codes do not."""
    made, projections = pairs_at(sample, threshold), []
    met, limit = [np.zeros(len(x), bool) for x, _ in made], 0
    while len(projections) < CODES[-1]:
        mean, projection = learn_rotation(sample, bits, seed=7 + len(projections))
        projections.append(projection)
        for k, (x, y) in enumerate(made):
            differ = _signs(x, mean, projection) != _signs(y, mean, projection)
            met[k] |= np.add.reduceat(differ, np.arange(0, bits, CHUNK), axis=1, dtype=int).min(1) <= 1
            limit = max(limit, int(differ.sum(1).max())) if len(projections) == 1 else limit
        if len(projections) in CODES and all(m.mean() >= RECALL for m in met):
            return mean, projections, limit
    return None


def _coded(classes: DataFrame, wide: int, mean: np.ndarray, projections: list[np.ndarray]) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column("embedding"), wide)
            padded = np.zeros((len(unit), len(projections), BITS), bool)
            for k, projection in enumerate(projections):
                padded[:, k, : projection.shape[1]] = _signs(unit, mean, projection)
            codes = np.packbits(padded, axis=2, bitorder="little").view("<i8").reshape(len(unit), len(projections))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(codes), pa.list_(pa.int64()))], ["rep", "codes"])

    return classes.select("rep", "embedding").mapInArrow(gives_back(code), "rep long, codes array<long>")


def _slots(codes: DataFrame, bits: int, count: int) -> tuple[DataFrame, DataFrame]:
    """(index: b, cb, slot; probe: a, ca, slot) of the ``count`` codes; the tables cover the ``bits`` that codes have."""
    tables = [(k, t) for k in range(count) for t in range(-(-bits // CHUNK))]
    chunk = lambda k, t: F.shiftrightunsigned(F.get("codes", F.lit(k)), t * CHUNK).bitwiseAND((1 << CHUNK) - 1)
    flips = [0, *(1 << k for k in range(CHUNK))]
    start = codes.withColumns({"code": F.get("codes", F.lit(0)), "chunks": F.array(*[chunk(k, t) + F.lit((k * BITS // CHUNK + t) << CHUNK) for k, t in tables])})
    flipped = F.flatten(F.transform("chunks", lambda c: F.array(*[c.bitwiseXOR(F.lit(f).cast("long")) for f in flips])))
    index = start.select(F.col("rep").alias("b"), F.col("code").alias("cb"), F.explode(F.col("chunks").cast("array<int>")).alias("slot"))
    probe = start.select(F.col("rep").alias("a"), F.col("code").alias("ca"), F.explode(flipped.cast("array<int>")).alias("slot"))
    return index, probe


def candidate_links(codes: DataFrame, classes: DataFrame, bits: int, most_bits: int, count: int, wide: int, threshold: float) -> DataFrame:
    """Links (a, b) that leave the components as all links of the tables' candidates would.

    A slot with few candidates gives its pairs, which are reranked; of one with more than ``LARGE`` the vectors are compared
    in blocks, of which only a star for each component inside a block comes out.
    """
    index, probe = _slots(codes, bits, count)
    held = index.groupBy("slot").agg(F.count("*").alias("held"))
    asked = probe.groupBy("slot").agg(F.count("*").alias("asked"))
    large = stored(held.join(asked, "slot").filter(F.col("held") * F.col("asked") > LARGE), "large-slots")  # of 2^16 a table at most
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= most_bits)
    few = lambda rows: rows.join(F.broadcast(large.select("slot")), "slot", "left_anti")
    pairs = stored(few(probe).join(few(index), "slot").filter(near).select("a", "b").distinct(), "vector-pairs")
    links = _reranked(pairs, classes, wide, threshold)
    if large.isEmpty():
        return links
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    of = F.broadcast(large.select("slot", blocks("asked").alias("rows"), blocks("held").alias("columns")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    left = probe.select(F.col("a").alias("rep"), "slot").join(of, "slot").select("slot", own("rows").alias("i"), every("columns").alias("j"), "rep", F.lit(True).alias("left"))
    right = index.select(F.col("b").alias("rep"), "slot").join(of, "slot").select("slot", every("rows").alias("i"), own("columns").alias("j"), "rep", F.lit(False).alias("left"))
    cells = left.unionByName(right).join(classes.select("rep", "embedding"), "rep")
    return links.unionByName(cells.groupBy("slot", "i", "j").applyInArrow(_starred(wide, threshold), "a long, b long"))


def _linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit rows have a cosine of the threshold or more; what is near it is computed again, pair by pair."""
    cosine = left @ right.T
    linked = cosine >= threshold
    p, q = np.nonzero(np.abs(cosine - threshold) < 1e-9)
    linked[p, q] = np.einsum("ij,ij->i", left[p], right[q]) >= threshold
    return linked


def _starred(wide: int, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Of a block (rep, left, embedding): each vector of a component of left-to-right links with the component's smallest."""

    def star(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        unit, rep = _matrix(group.column("embedding").combine_chunks(), wide), group.column("rep").to_numpy()
        side = group.column("left").to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        linked = _linked(unit[left], unit[right], threshold)
        a, b = rep[left], rep[right]
        least, most = rep.copy(), np.iinfo(np.int64).max
        while True:  # the least rep reaches one link further a round
            before = least.copy()
            least[left] = np.minimum(least[left], np.where(linked, least[right], most).min(1, initial=most))
            least[right] = np.minimum(least[right], np.where(linked.T, least[left], most).min(1, initial=most))
            if (least == before).all():
                break
        moved = np.unique(np.stack([np.r_[least[left], least[right]], np.r_[a, b]], 1), axis=0)
        moved = moved[moved[:, 0] != moved[:, 1]]
        return pa.table({"a": moved[:, 0], "b": moved[:, 1]})

    return star


def _compared(classes: DataFrame, rows: int, wide: int, threshold: float) -> DataFrame:
    """Stars of the links of all classes, each pair of blocks in a group of its own."""
    blocks = -(-rows // BLOCK)
    placed = classes.select("rep", "embedding", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    to = lambda c: F.explode(F.sequence(*c)).alias("other")
    left = placed.select("rep", "embedding", F.col("block").alias("i"), to((F.col("block"), F.lit(blocks - 1)))).withColumnRenamed("other", "j")
    right = placed.select("rep", "embedding", F.col("block").alias("j"), to((F.lit(0), F.col("block")))).withColumnRenamed("other", "i")
    dealt = left.withColumn("left", F.lit(True)).unionByName(right.withColumn("left", F.lit(False)))
    return dealt.groupBy("i", "j").applyInArrow(_starred(wide, threshold), "a long, b long")


def _reranked(pairs: DataFrame, classes: DataFrame, wide: int, threshold: float) -> DataFrame:
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.einsum("ij,ij->i", _matrix(batch.column("ea"), wide), _matrix(batch.column("eb"), wide))
            yield batch.select(["a", "b"]).filter(pa.array(cosine >= threshold))

    side = lambda n: classes.select(F.col("rep").alias(n), F.col("embedding").alias("e" + n))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(gives_back(rerank), "a long, b long")


def count_links(placed: DataFrame, wide: int, threshold: float) -> DataFrame:
    """(rep, others): how many vectors of other classes each class is linked to, from (root, rep, copies, embedding).

    Links are within components, so the classes of a component are compared with each other, in blocks of about ``BLOCK``;
    small components share a group.
    """
    sizes = placed.groupBy("root").agg(F.count("*").alias("size"))
    small = -(-(sizes.agg(F.sum(F.when(F.col("size") <= BLOCK, F.col("size")))).first()[0] or 1) // BLOCK)
    sized = placed.join(sizes, "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    own, every = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(small))).otherwise(F.col("root")).alias("group")
    rest = ["root", "rep", "copies", "embedding", "blocks"]
    left = sized.select(group, own.alias("i"), every.alias("j"), *rest, F.lit(True).alias("left"))
    right = sized.filter("blocks > 1").select(group, every.alias("i"), own.alias("j"), *rest, F.lit(False).alias("left"))

    def count(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks().sort_by("root")
        unit = _matrix(cell.column("embedding").combine_chunks(), wide)
        root, rep, copies = (cell.column(c).to_numpy() for c in ("root", "rep", "copies"))
        left, one = cell.column("left").to_numpy(), cell.column("blocks").to_numpy() == 1
        reps, others = [], []
        for rows in np.split(np.arange(len(root)), np.flatnonzero(np.diff(root)) + 1):
            x, y = rows[left[rows]], rows[one[rows] | ~left[rows]]
            linked = _linked(unit[x], unit[y], threshold) & (rep[x][:, None] != rep[y])
            reps.append(rep[x])
            others.append(linked @ copies[y])
        return pa.table({"rep": np.concatenate(reps), "others": np.concatenate(others)})

    counted = left.unionByName(right).groupBy("blocks", "group", "i", "j").applyInArrow(count, "rep long, others long")
    return counted.groupBy("rep").agg(F.sum("others").alias("others"))


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: vec_id, usable, value; classes of equal vectors: value, rep, copies, embedding)."""
    value = F.struct(F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g")).alias("value")
    keyed = vectors.select("vec_id", "embedding", _usable().alias("usable"), value)
    usable = keyed.filter("usable")
    counts = usable.groupBy("value").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    own = usable.select(F.col("vec_id").alias("rep"), "value", "embedding").dropDuplicates(["rep", "value"])
    return keyed.select("vec_id", "usable", "value"), stored(own.join(counts, ["value", "rep"]), "vector-classes")


def embedding_links(classes: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(links a, b that span the components, the width of the vectors)."""
    shape = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    wide = shape[1] or 1
    share = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(shape[0], 1)))
    picked = [r[0] for r in classes.filter(share).orderBy("rep").select("embedding").limit(2 * SAMPLE).collect()]
    sample = _matrix(pa.array(picked, pa.list_(pa.float64())), wide) if picked else np.zeros((1, wide))
    bits = min(BITS, wide)
    chosen = choose_codes(sample, bits, threshold)
    if chosen is None:
        links = _compared(classes, shape[0], wide, threshold)
    else:
        mean, projections, limit = chosen
        codes = stored(_coded(classes, wide, mean, projections), "codes")
        links = candidate_links(codes, classes, bits, limit, len(projections), wide, threshold)
    return stored(links, "vector-links"), wide


def embedding_report(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    members, classes = vector_classes(vectors)
    links, wide = embedding_links(classes, threshold)
    roots = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "rep")
    linked = count_links(stored(classes.join(roots, "rep").select("root", "rep", "copies", "embedding"), "linked-vectors"), wide, threshold)
    placed = classes.drop("embedding").join(linked, "rep", "left").join(roots, "rep", "left")
    placed = placed.select("value", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), F.col("copies").alias("n"))
    usable = salted_join(members.filter("usable").select("vec_id", "value"), placed, "value", "vec_id")
    alone = members.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = usable.select("vec_id", F.col("n_links").cast("long"), "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def keep_one_vector(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vectors`` with one row for each group of near copies, the smallest vec_id's."""
    gone = embedding_report(vectors, threshold).filter("not kept").select(F.col("vec_id").alias("gone")).distinct()
    whole = vectors.select(F.struct("*").alias("v"))
    return whole.join(gone, F.col("v.vec_id") == F.col("gone"), "left_anti").select("v.*")
