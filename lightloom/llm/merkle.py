"""Merkle manifest of a table of documents: a leaf for each row, a tree for each language, a tree over the languages.

Where a leaf stands needs no sort of leaves. It follows from bitmaps of the doc_ids, one for each language:

1. A bitmap is its words of 64 ids, of which only those with a bit set exist. Words of all tasks merge by OR.
2. The popcount directory has, for each word, how many rows have a smaller id: prefix sums over words, blocks of
   ``FANOUT`` words, blocks of those, and so on, so no window is longer than ``FANOUT`` rows whatever the ids are.
3. A rank query (``ranked``) looks its word up: the directory's number plus the bits below its own. Ids of several rows
   have more than one place; only words that have more rows than bits are looked at for those.
4. Leaves go into arrays of 8^3 keyed slots. An array reduces by three levels at once and is one slot of the next array
   (``raised``); siblings come back down along the same arrays (``descended``), so a leaf meets its whole path in its array.

Only ids and digests are shuffled, texts never. A digest H is the lower-case hex SHA-256 of what it covers, joined; digests
enter as hex text. Every 8 consecutive nodes (the last run may have fewer, even one) have one parent.

Defined results: a null value is covered as ``-``, every other as its UTF-8 length, ``:`` and itself; null languages form a
tree of their own, the first; null doc_ids come first in their tree; rows that share a doc_id are ordered by leaf, and equal
rows have places of their own; a null doc_id is never tampered with; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, stored

ARITY = 8
LEVELS = 3
SLOTS = ARITY**LEVELS
SLOT_BITS = 3 * LEVELS
#: Rows of a directory level that share a row of the level above.
FANOUT_BITS = 8
FANOUT = 1 << FANOUT_BITS
WORD_BITS = 6
#: The word of null ids, before every word of a long.
NULL_WORD = -(1 << (63 - WORD_BITS)) - 1
#: Rows of one repeated id are placed by this many first letters of their leaf, then inside.
PREFIX = 3
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(values: dict[str, Column]) -> Column:
    """The leaf of a row's covered values, in the order of ``COVERED``."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return digest(F.concat(*[told(values[n].cast("string")) for n in COVERED]))


def merkle_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the language's key), leaf."""
    return docs.select("doc_id", _tree(F.col("lang")).alias("tree"), leaf_of({n: F.col(n) for n in COVERED}).alias("leaf"))


def _tree(lang: Column) -> Column:
    """Keys whose order is the languages': null is the empty key."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def _shift(x: Column, bits: int) -> Column:
    return F.shiftright(x, bits)


def _word(doc_id: str) -> Column:
    return F.coalesce(_shift(F.col(doc_id), WORD_BITS), F.lit(NULL_WORD))


def _bit(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int")


def _one_at(bit: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bit))


def bitmaps(leaves: DataFrame) -> DataFrame:
    """(tree, word, bits, n): the words of each tree's bitmap of ids, with the number of their rows."""
    marked = leaves.select("tree", _word("doc_id").alias("word"), _bit("doc_id").alias("bit_"))
    return marked.groupBy("tree", "word").agg(F.bit_or(_one_at("bit_")).alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """``words``, from ``low`` to ``high``, with ``before``, the rows of the same tree in smaller words, and ``size``, the tree's rows."""
    levels = [words.select("tree", F.col("word").alias("at"), "n")]
    while low is not None and high - low >= FANOUT:
        low, high = low >> FANOUT_BITS, high >> FANOUT_BITS
        above = levels[-1].groupBy("tree", _shift(F.col("at"), FANOUT_BITS).alias("at")).agg(F.sum("n").alias("n"))
        levels.append(stored(above, "merkle-directory"))
    sizes = levels[-1].groupBy("tree").agg(F.sum("n").alias("size"))
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    base = None
    for level in reversed(levels):
        if base is None:
            counted = level.withColumn("before", F.coalesce(F.sum("n").over(earlier("tree")), F.lit(0)))
        else:
            block = level.withColumn("block", _shift(F.col("at"), FANOUT_BITS))
            inside = F.coalesce(F.sum("n").over(earlier("tree", "block")), F.lit(0))
            above = base.select("tree", F.col("at").alias("block"), F.col("before").alias("base"))
            counted = block.withColumn("inside", inside).join(above, ["tree", "block"]).withColumn("before", F.col("base") + F.col("inside"))
        base = counted.select("tree", "at", "before")
    return words.join(base.withColumnRenamed("at", "word"), ["tree", "word"]).join(sizes, "tree")


def _repeated(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """(tree, word, bit, id_rows) of ids with several rows; only words with more rows than bits are counted by id."""
    full = words.filter(F.col("n") > F.bit_count("bits")).select("tree", "word")
    own = leaves.select("tree", _word("doc_id").alias("word"), _bit("doc_id").alias("bit")).join(full, ["tree", "word"], "left_semi")
    return own.groupBy("tree", "word", "bit").agg(F.count("*").alias("id_rows")).filter("id_rows > 1")


def _among_equals(rows: DataFrame) -> DataFrame:
    """Rows of repeated ids, equal ones as one with their number ``n_equal``: with ``offset``, the rows of the id before them."""
    part = rows.withColumn("part", F.substring("leaf", 1, PREFIX))
    one = ("tree", "word", "bit")
    sums = part.groupBy(*one, "part").agg(F.sum("n_equal").alias("n"))
    before = Window.partitionBy(*one).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*one, "part").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*one, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = part.withColumn("inside", F.coalesce(F.sum("n_equal").over(inside), F.lit(0))).join(starts, [*one, "part"])
    return placed.withColumn("offset", F.col("start") + F.col("inside")).drop("part", "start", "inside")


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (stored; tree, doc_id, leaf and what follows from them) with ``pos``, the place in the tree, and ``size``."""
    words = stored(bitmaps(leaves), "merkle-bitmaps")
    low, high, full = words.agg(F.min("word"), F.max("word"), F.count_if(F.col("n") > F.bit_count("bits"))).first()
    keyed = leaves.withColumns({"word": _word("doc_id"), "bit": _bit("doc_id")})
    indexed = directory(words, low, high)
    if not full:
        found = keyed.join(indexed, ["tree", "word"])
        return found.withColumn("pos", F.col("before") + _below()).drop("word", "bit", "bits", "n", "before")
    repeated = stored(_repeated(leaves, words), "merkle-repeated")
    extra = repeated.groupBy("tree", "word").agg(F.collect_list(F.struct("bit", (F.col("id_rows") - 1).alias("more"))).alias("extra"))
    indexed = stored(indexed.join(extra, ["tree", "word"], "left"), "merkle-directory")
    more = F.aggregate(F.coalesce("extra", F.array().cast("array<struct<bit:int,more:bigint>>")), F.lit(0).cast("long"), lambda s, e: s + F.when(e["bit"] < F.col("bit"), e["more"]).otherwise(0))
    ids = repeated.select("tree", "word", "bit")
    alone = keyed.join(ids, ["tree", "word", "bit"], "left_anti").withColumns({"n_equal": F.lit(1).cast("long"), "offset": F.lit(0).cast("long")})
    several = keyed.join(ids, ["tree", "word", "bit"], "left_semi").groupBy(*keyed.columns).agg(F.count("*").alias("n_equal"))
    both = alone.unionByName(_among_equals(stored(several, "merkle-equals"))).join(indexed, ["tree", "word"])
    placed = both.withColumn("pos", F.col("before") + _below() + more + F.col("offset"))
    each = placed.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_equal") - 1))).withColumn("pos", F.col("pos") + F.col("turn"))
    return each.select(*leaves.columns, "size", "pos")


def _low_ones(bit: str) -> Column:
    """All bits below ``bit``; no arithmetic, which 63 would overflow."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col(bit)))


def _below() -> Column:
    """Bits of a word under ``bit``."""
    return F.bit_count(F.col("bits").bitwiseAND(_low_ones("bit"))).cast("long")


def _parents(hashes: Column) -> Column:
    """An array of nodes to that of their parents."""
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda k: digest(F.concat_ws("", F.slice(hashes, k * ARITY + 1, ARITY))))


def _levels(size: Column) -> Column:
    """How many levels an array reduces by: until one node is left, three at most."""
    return F.when(size <= 1, 0).when(size <= ARITY, 1).when(size <= ARITY**2, 2).otherwise(LEVELS)


def _siblings(k: int, slot: Column) -> Column:
    """What stands left and right of the node above ``slot`` in its run, on level k of a slot array."""
    at = F.floor(slot / ARITY**k).cast("int")
    inside = at % ARITY
    row = F.col(f"h{k}")
    join = lambda first, n: F.concat_ws("", F.slice(row, first, n))
    return F.struct(join(at - inside + 1, inside).alias("left"), join(at + 2, F.lit(ARITY - 1) - inside).alias("right"))


_PATH = "array<struct<left:string,right:string>>"


def raised(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, pos, size, hash, own: a struct) the levels of slot arrays up to each tree's top, and (tree, top). Nodes of a
    tree have the places 0 to size - 1, each once; ``own`` goes along with its node."""
    slots = F.sort_array(F.collect_list(F.struct((F.col("pos") % SLOTS).cast("int").alias("slot"), "hash", "own"))).alias("slots")
    arrays = nodes.groupBy("tree", "size", _shift(F.col("pos"), SLOT_BITS).alias("block")).agg(slots)
    arrays = arrays.withColumn("h0", F.col("slots.hash"))
    for k in range(LEVELS):
        arrays = arrays.withColumn(f"h{k + 1}", F.when(_levels(F.col("size")) > k, _parents(F.col(f"h{k}"))).otherwise(F.col(f"h{k}")))
    arrays = stored(arrays, "merkle-arrays")
    above = arrays.select("tree", F.col("block").alias("pos"), _shift(F.col("size") + SLOTS - 1, SLOT_BITS).alias("size"), F.get(f"h{LEVELS}", F.lit(0)).alias("hash"), F.struct("tree", "block").alias("own"))
    most = above.agg(F.max("size")).first()[0]
    if most is None or most <= 1:
        return [arrays], above.select("tree", F.col("hash").alias("top"))
    levels, tops = raised(above)
    return [arrays, *levels], tops


def descended(levels: list[DataFrame], way: DataFrame) -> DataFrame:
    """The lowest level's ``own``, with ``path``, the siblings of the node level by level, and the other columns of ``way``: (tree,
    way: the path from the tree's top on, more). A path comes down to whole arrays, so nodes and paths are never shuffled."""
    more = [c for c in way.columns if c not in ("tree", "way")]
    way = way.withColumn("block", F.lit(0).cast("long"))
    for arrays in reversed(levels):
        met = arrays.join(way, ["tree", "block"])
        each = met.select("size", "way", *more, *[f"h{k}" for k in range(LEVELS)], F.explode("slots").alias("s"))
        own = F.array(*[F.when(_levels(F.col("size")) > k, _siblings(k, F.col("s.slot"))) for k in range(LEVELS)])
        path = F.concat(F.filter(own, lambda x: x.isNotNull()).cast(_PATH), F.col("way"))
        each = each.select("s.own", path.alias("path"), *more)
        if arrays is not levels[0]:
            way = each.select("own.tree", "own.block", F.col("path").alias("way"), *more)
    return each


def _dense(keys: DataFrame, column: str) -> DataFrame:
    """Distinct ``column`` with ``pos``, its place in ascending order: sorted by ranges, the ranges' counts are summed."""
    ranged = keys.select(column).distinct().repartitionByRange(F.col(column)).select(column, F.spark_partition_id().alias("range"))
    ranged = stored(ranged, "merkle-trees")
    first = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(column)) - 1
    return ranged.withColumn("inside", inside).join(starts, "range").select(column, (F.col("start") + F.col("inside")).cast("long").alias("pos"))


def manifest(leaves: DataFrame) -> DataFrame:
    """``leaves`` (doc_id, tree, leaf, more) with subroot, root and ``path``: array of (left, right) from leaf to root."""
    leaves = stored(leaves, "merkle-leaves")
    placed = ranked(leaves).select("tree", "pos", "size", F.col("leaf").alias("hash"), F.struct(*leaves.columns).alias("own"))
    levels, tops = raised(placed)
    subroots = stored(tops.withColumnRenamed("top", "subroot"), "merkle-subroots")
    nodes = subroots.join(_dense(subroots, "tree"), "tree").select(F.lit("").alias("tree"), "pos", F.lit(subroots.count()).cast("long").alias("size"), F.col("subroot").alias("hash"), F.struct("tree", "subroot").alias("own"))
    high, root = raised(nodes)
    told = descended(high, root.select("tree", F.array().cast(_PATH).alias("way"), F.col("top").alias("root")))
    return descended(levels, told.select("own.*", F.col("path").alias("way"), "root")).select("own.*", "subroot", "root", "path")


def proof(path: Column) -> Column:
    return F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.concat(p["left"], h, p["right"])))


def merkle_report(docs: DataFrame, every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: proofs of all rows, folded from a tampered leaf where
    ``every`` divides the crc32 of doc_id."""
    values = {n: F.col(n) for n in COVERED}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    tampered = F.when(touched, leaf_of(values | {"text": ascii_lower(F.col("text"))}))
    leaves = docs.select("doc_id", _tree(F.col("lang")).alias("tree"), leaf_of(values).alias("leaf"), tampered.alias("tampered"))
    told = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return told.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
