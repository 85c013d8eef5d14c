"""LM scoring with a hashed maximum-entropy model: n-gram and skip features, a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Both factors are softmaxes whose logits add up a bias and
the weights of hashed features of the history: for the class the word before, the two words before and the word before that
one (a skip); for the word, each together with the class, the word before and the skip. Features are hashes of the words
themselves, so the rarest word has its own. A factor's weights are a table of ``SLOTS`` rows, one column for each class, or
for each place in a class.

Classes are groups of words that keep company with the same very frequent words. A group's ``BANDS * WIDE`` most frequent words
are dealt to classes of up to ``WIDE`` words, by frequency; its other numbered words are one class more, in which a word has
its share of the counts whatever the history. So have the words beyond the ``MAX_WORDS`` most frequent, unseen ones too,
in the last class. All probabilities of a place sum to one.

Training runs over all training documents, in ``ROUNDS`` rounds over a part each: every task takes mini-batch gradient steps
from the weights sent to it, and the tasks' weights are averaged by tokens, block by block of the tables, in Spark; what the
driver gets is one model, whatever the number of tasks. Scoring takes documents in numpy batches. Counts of words beyond
the numbered ones come by a join: the model that tasks hold is bounded, the counts behind a score are those of all tokens.

Defined results: null and empty texts have the end token only; rows that repeat are scored alike; with no training
documents every probability is 1 (scores 0) for the base and the model's word factor.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gives_back, stored

ALPHA = 0.1
MAX_WORDS = 100_000
CLUSTERS, BANDS, WIDE, SEEDS = 5, 5, 48, 12
CLASSES = CLUSTERS * (BANDS + 1) + 1
SLOTS = 1 << 14
ROUNDS = 3
BATCH = 1 << 12
RATE = 1.0
END, RARE = 0, 1
_FLUSH = 300_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 10 is 0; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts, pre-aggregated in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            columns = [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > _FLUSH:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("text").mapInArrow(gives_back(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """What tasks hold: the most frequent words with their numbers and counts, and the corpus's totals."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    types: int
    rare_tokens: int
    rare_types: int


def vocabulary(counts: DataFrame, documents: int, max_words: int = MAX_WORDS) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 64).cast("int")  # words of a level are numbered all or not at all
    least, held = None, 0
    for row in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        held += row.words
        if held > max_words:
            break
        least = row.level
    top = [] if least is None else sorted(counts.filter(level >= least).collect(), key=lambda r: (-r[1], bytes(r[0])))
    numbers = {bytes(r[0]): k for k, r in enumerate(top, 2)}
    known = np.array([documents, 0, *(r[1] for r in top)], np.int64)
    in_top = int(known[2:].sum())
    return Vocabulary(
        numbers, known, total[0] + documents, total[1] + (documents > 0), total[0] - in_top, total[1] - len(top)
    )


def _code(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = _code(word)
        return code


def numbered(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """From ``d``, ``text`` and ``learn``: d, learn, numbers (int32 of all tokens, the end too), codes (uint32 of the rare ones),
    rare and times (each rare word and how often)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab.numbers)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, code = shared.value.get, _Codes()
        for batch in batches:
            numbers, codes, rare, times = [], [], [], []
            for text in batch.column("text"):
                own = words_of(text.as_py())
                row = [get(w, RARE) for w in own]
                others = [w for w, k in zip(own, row, strict=True) if k == RARE]
                if len(code) > _FLUSH:
                    code.clear()
                row.append(END)
                numbers.append(np.array(row, np.int32).tobytes())
                codes.append(np.array([code[w] for w in others], np.uint32).tobytes())
                counts = Counter(others)
                rare.append(list(counts.keys()))
                times.append(list(counts.values()))
            columns = [batch.column("d"), batch.column("learn"), pa.array(numbers, pa.binary()), pa.array(codes, pa.binary())]
            columns += [pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["d", "learn", "numbers", "codes", "rare", "times"])

    schema = docs.select("d", "learn").schema.add("numbers", "binary").add("codes", "binary").add("rare", T.ArrayType(T.BinaryType())).add("times", T.ArrayType(T.LongType()))
    return docs.mapInArrow(gives_back(number), schema)


class _Run(NamedTuple):
    """Documents one after another: where they start, the numbers and the word codes of all tokens."""

    starts: np.ndarray
    numbers: np.ndarray
    codes: np.ndarray


def _runs(batches: Iterator[pa.RecordBatch], code_of: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, _Run]]:
    """Rows of ``numbered`` with about ``most`` tokens at a time."""
    for batch in batches:
        sizes = np.array([len(x.as_buffer()) // 4 for x in batch.column("numbers")])
        total, begun = np.cumsum(sizes), 0
        while begun < len(sizes):
            end = max(begun + 1, int(np.searchsorted(total, (total[begun - 1] if begun else 0) + most)))
            part = batch.slice(begun, end - begun)
            numbers = np.frombuffer(b"".join(part.column("numbers").to_pylist()), np.int32)
            codes = code_of[numbers]
            codes[numbers == RARE] = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint32)
            own = sizes[begun:end]
            yield part, _Run(np.cumsum(own) - own, numbers, codes)
            begun = end


def _code_table(vocab: Vocabulary) -> np.ndarray:
    return np.array([0, 0, *map(_code, vocab.numbers)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def features(run: _Run, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int [3, tokens] and [2, tokens]: the slots of the class factor and those of the word factor, given each token's class."""
    one = np.r_[np.uint64(0), run.codes[:-1]]
    one[run.starts] = 0
    two = np.r_[np.uint64(0), one[:-1]]
    two[run.starts] = 0
    kind = (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    first = [one * 0x9E3779B97F4A7C15 + 1, (one * 0xC2B2AE3D27D4EB4F ^ two * 0x165667B19E3779F9) + 2, two * 0xD6E8FEB86659FD93 + 3]
    second = [(one * 0xFF51AFD7ED558CCD ^ kind) + 4, (two * 0xC4CEB9FE1A85EC53 ^ kind) + 5]
    return np.stack(list(map(_mixed, first))), np.stack(list(map(_mixed, second)))


def _summed(rows: DataFrame, blocks: int) -> list[np.ndarray]:
    """Vectors of float16 (block int, weight double, data binary) of all tasks to their sums by weight, one a block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One batch at a time: a block of all tasks, however many they are, is never in memory at once."""
        total, block = 0.0, None
        for batch in batches:
            block = batch.column(0).slice(0, 1)
            for data, weight in zip(batch.column(2), batch.column(1).to_pylist(), strict=True):
                total = total + np.frombuffer(data.as_buffer(), np.float16).astype(np.float64) * weight
        data = np.asarray(total, np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([block, pa.array([data], pa.binary())], ["block", "data"])

    got = {r.block: np.frombuffer(r.data, np.float32) for r in rows.select("block", "weight", "data").groupBy("block").applyInArrow(add, "block int, data binary").collect()}
    return [got[k] for k in range(blocks)] if got else []


def _sent(table: np.ndarray, weight: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """A task's table, in ``blocks`` rows for ``_summed``."""
    for k, part in enumerate(np.array_split(table.ravel(), blocks)):
        columns = [pa.array([k], pa.int32()), pa.array([weight], pa.float64()), pa.array([part.astype(np.float16).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "weight", "data"])


_SENT = "block int, weight double, data binary"


class Classes(NamedTuple):
    """Of every number its class and place there; of every class whether history tells its words apart."""

    of: np.ndarray
    place: np.ndarray
    told: np.ndarray


def word_classes(docs: DataFrame, vocab: Vocabulary, blocks: int = 8) -> Classes:
    """From ``numbered`` documents, by the very frequent words that a word meets in them."""
    size = len(vocab.counts)
    of, place, told = np.full(size, CLASSES - 1), np.zeros(size, int), np.arange(CLASSES) % (BANDS + 1) != BANDS
    told[CLASSES - 1] = False
    of[END] = 0
    if size <= 2:
        return Classes(of, place, told)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, none = np.zeros((size, SEEDS + 1), np.float32), np.zeros(size, np.uint64)
        for _, run in _runs(batches, none):
            document = np.repeat(np.arange(len(run.starts)), np.diff(np.r_[run.starts, len(run.numbers)]))
            pair = np.unique(document * size + run.numbers)
            document, kind = pair // size, pair % size
            seen = np.zeros((len(run.starts), SEEDS + 1), np.float32)
            seed = (kind >= 2) & (kind < 2 + SEEDS)
            seen[document[seed], kind[seed] - 2] = 1
            seen[:, SEEDS] = 1
            for k in range(SEEDS + 1):
                table[:, k] += np.bincount(kind, seen[document, k], size)
        most = max(1.0, float(table.max()))
        yield from _sent(table / most, most, blocks)

    table = np.concatenate(_summed(docs.mapInArrow(gives_back(meet), _SENT), blocks)).reshape(size, SEEDS + 1)
    profile = table[:, :SEEDS] / np.maximum(table[:, SEEDS:], 1)
    cluster = _cluster(profile[2:], vocab.counts[2:])
    for c in range(CLUSTERS):
        own = 2 + np.flatnonzero(cluster == c)  # most frequent first
        own = np.r_[END, own] if c == cluster[0] else own
        rank = np.arange(len(own))
        of[own] = c * (BANDS + 1) + np.minimum(rank // WIDE, BANDS)
        place[own] = np.where(rank < BANDS * WIDE, rank % WIDE, 0)
    return Classes(of, place, told)


def _cluster(profile: np.ndarray, weight: np.ndarray, rounds: int = 20) -> np.ndarray:
    """k-means weighted by count, started from words far apart."""
    points = profile.astype(np.float64)
    often = points[: 4 * CLUSTERS]
    centres = often[:1]
    while len(centres) < CLUSTERS:
        away = ((often[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, often[int(np.argmax(away))]])
    nearest = np.zeros(len(points), int)
    for _ in range(rounds):
        nearest = ((points[:, None] - centres) ** 2).sum(2).argmin(1)
        for c in range(CLUSTERS):
            own = nearest == c
            if own.any():
                centres[c] = np.average(points[own], axis=0, weights=weight[own])
    return nearest


class Model(NamedTuple):
    vocab: Vocabulary
    classes: Classes
    codes: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray
    class_weights: np.ndarray
    word_weights: np.ndarray
    class_mass: np.ndarray


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return logits


def _logits(weights: np.ndarray, slots: np.ndarray, bias: np.ndarray) -> np.ndarray:
    total = weights[slots[0]]
    for own in slots[1:]:
        total += weights[own]
    total += bias
    return total


def descend(weights: np.ndarray, slots: np.ndarray, bias: np.ndarray, target: np.ndarray) -> None:
    """One mini-batch step of a factor; a feature's step is its mean residual. Steps add up to zero over a row, so no row of
    logits is small as a whole, and none is let grow beyond what exp bears."""
    residual = _logits(weights, slots, bias)
    np.minimum(residual, np.float32(60), out=residual)
    np.exp(residual, out=residual)
    residual /= residual.sum(1, keepdims=True)
    residual[np.arange(len(target)), target] -= 1
    for own in slots:
        order = np.argsort(own.astype(np.uint16), kind="stable")
        sorted_slots = own[order]
        first = np.flatnonzero(np.r_[True, sorted_slots[1:] != sorted_slots[:-1]])
        size = np.diff(np.r_[first, len(own)])
        weights[sorted_slots[first]] -= np.add.reduceat(residual[order], first) * (RATE / (size + 5.0)).astype(np.float32)[:, None]


def fit(docs: DataFrame, vocab: Vocabulary, blocks: int = 16) -> Model:
    """From ``numbered`` training documents."""
    context = docs.sparkSession.sparkContext
    classes, codes = word_classes(docs, vocab), _code_table(vocab)
    smooth = vocab.counts + ALPHA * (np.arange(len(classes.of)) != RARE)
    mass = np.bincount(classes.of, smooth, CLASSES)
    mass[CLASSES - 1] += vocab.rare_tokens + ALPHA * (vocab.rare_types + 1)
    class_bias = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
    word_bias = np.full((CLASSES, WIDE), -1e9, np.float32)
    own = np.flatnonzero(classes.told[classes.of] & (smooth > 0))
    word_bias[classes.of[own], classes.place[own]] = np.log(smooth[own])
    model = Model(vocab, classes, codes, class_bias, word_bias, np.zeros((SLOTS, CLASSES), np.float32), np.zeros((SLOTS, WIDE), np.float32), mass)
    part = F.pmod(F.xxhash64("rid"), F.lit(ROUNDS))
    for r in range(ROUNDS):
        sent = context.broadcast(model._replace(vocab=None))

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m: Model = sent.value
            upper, lower, seen = m.class_weights.copy(), m.word_weights.copy(), 0
            for _, run in _runs(batches, m.codes):
                kind = m.classes.of[run.numbers]
                slots, inner = features(run, kind)
                place, told = m.classes.place[run.numbers], m.classes.told[kind]
                for a in range(0, len(kind), BATCH):
                    b = a + BATCH
                    descend(upper, slots[:, a:b], m.class_bias, kind[a:b])
                    own = a + np.flatnonzero(told[a:b])
                    if len(own):
                        descend(lower, inner[:, own], m.word_bias[kind[own]], place[own])
                seen += len(kind)
            if seen:
                yield from _sent(np.r_[upper.ravel(), lower.ravel(), np.ones(1, np.float32)], float(seen), blocks)

        total = _summed(docs.filter(part == r).mapInArrow(gives_back(train), _SENT), blocks)
        sent.unpersist()
        if total:
            flat = np.concatenate(total)
            flat = flat[:-1] / flat[-1]
            cut = SLOTS * CLASSES
            model = model._replace(class_weights=flat[:cut].reshape(SLOTS, CLASSES), word_weights=flat[cut:].reshape(SLOTS, WIDE))
    return model


def log_probabilities(run: _Run, m: Model) -> np.ndarray:
    """Natural log of P(class | history) * P(word | class, history) of every token; for rare words of the class alone."""
    kind = m.classes.of[run.numbers]
    slots, inner = features(run, kind)
    place, told = m.classes.place[run.numbers], m.classes.told[kind]
    share = np.log(np.maximum(m.vocab.counts + ALPHA, 1e-9)) - np.log(np.maximum(m.class_mass, 1e-9))[m.classes.of]
    out = np.where(told | (run.numbers == RARE), 0.0, share[run.numbers])
    for a in range(0, len(kind), BATCH):
        b = min(a + BATCH, len(kind))
        out[a:b] += _log_softmax(_logits(m.class_weights, slots[:, a:b], m.class_bias))[np.arange(b - a), kind[a:b]]
        own = a + np.flatnonzero(told[a:b])
        if len(own):
            out[own] += _log_softmax(_logits(m.word_weights, inner[:, own], m.word_bias[kind[own]]))[np.arange(len(own)), place[own]]
    return out


def score(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """From ``numbered`` rows: d, n_tokens, n_known, train_tokens, base_score and score."""
    shared = rows.sparkSession.sparkContext.broadcast(model._replace(vocab=model.vocab._replace(numbers={})))
    tokens_total = model.vocab.tokens
    floor = np.log10(tokens_total + ALPHA * (model.vocab.types + 1))
    rare_floor = np.log10(model.class_mass[CLASSES - 1])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        base_of = np.log10(m.vocab.counts + ALPHA) - floor
        base_of[RARE] = 0.0  # comes by the join
        known_of = (m.vocab.counts > 0).astype(np.int64)
        for part, run in _runs(batches, m.codes):
            total = lambda x, run=run: np.add.reduceat(x, run.starts)
            made = [total(np.ones(len(run.numbers), np.int64)), total(known_of[run.numbers]), total(base_of[run.numbers])]
            made.append(total(log_probabilities(run, m)) / np.log(10))
            yield pa.RecordBatch.from_arrays([part.column("rid"), *map(pa.array, made)], ["rid", "n_tokens", "known", "base", "own"])

    rated = rows.select("rid", "numbers", "codes").mapInArrow(gives_back(rate), "rid long, n_tokens long, known long, base double, own double")
    rare = rows.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    matched = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10(F.col("c") + F.lit(ALPHA))
    sums = matched.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * (log - float(floor))).alias("rare_base"),
        F.sum(F.col("times") * (log - float(rare_floor))).alias("rare_own"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rated.join(rows.select("rid", "d"), "rid").join(sums, "rid", "left").select(
        "d",
        "n_tokens",
        (F.col("known") + none("rare_known")).alias("n_known"),
        F.lit(tokens_total).cast("long").alias("train_tokens"),
        (F.col("base") + none("rare_base")).alias("base_score"),
        (F.col("own") + none("rare_own")).alias("score"),
    )


def learn_and_score(docs: DataFrame) -> DataFrame:
    """From ``d``, ``text`` and ``learn`` (does the model learn from the row): the rows of ``score``."""
    training = docs.filter("learn")
    counts = stored(word_counts(training), "word-counts")
    vocab = vocabulary(counts, training.count())
    rows = stored(numbered(docs, vocab).withColumn("rid", F.monotonically_increasing_id()), "numbered-words")
    return score(rows, fit(rows.filter("learn"), vocab), counts)


def lm_report(docs: DataFrame) -> DataFrame:
    held = held_out(F.col("doc_id"))
    scored = learn_and_score(docs.select(F.struct("doc_id").alias("d"), "text", (~held).alias("learn")))
    return scored.select(
        F.col("d.doc_id").alias("doc_id"), held_out(F.col("d.doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
