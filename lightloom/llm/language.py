"""Language ID, word first with backoff: a known word scores by its log frequency in each language, an unseen word by
its longest known character n-grams, shorter ones where those are unknown.

The model is small and bounded by parameters: at most ``max_words`` words and ``max_grams`` n-grams (most frequent
first), fitted on at most about ``sample_docs`` labelled documents, picked by a hash of their id. Counting words and
n-grams is Spark work over the sample; n-grams are counted from word counts, not from texts.

A text's score is the softmax over languages of the mean of its word scores times ``min(words, SHARPNESS)``, a tempered
posterior that does not saturate for long texts.

Defined results: ``und`` with score 0 for null texts and texts without a letter; ties go to the language first in order;
rows that repeat are rated alike; with no labelled rows every text is ``und``; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gives_back

UNKNOWN = "und"
SAMPLE_DOCS = 20_000
MAX_WORDS = 50_000
MAX_GRAMS = 50_000
GRAM_SIZES = (5, 4, 3, 2, 1)
SHARPNESS = 20
_WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 60_000
UNSEEN = -12.0


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 3 is 1; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


class LanguageModel:
    """Log frequencies of words and n-grams in each language: names to rows of two matrices."""

    def __init__(self, languages: list[str], words: dict[str, list[float]], grams: dict[str, list[float]]):
        self.languages = languages
        wide = max(len(languages), 1)
        self.words, self.word_logs = {w: k for k, w in enumerate(words)}, self._logs(words, wide)
        self.grams, self.gram_logs = {g: k for k, g in enumerate(grams)}, self._logs(grams, wide)

    @staticmethod
    def _logs(counts: dict[str, list[float]], wide: int) -> np.ndarray:
        """Per mille smoothing: what a language lacks has a thousandth of the entry's frequency in all. The last row,
        for what is unknown, is flat."""
        table = np.array(list(counts.values()), float).reshape(-1, wide)
        rates = table / np.maximum(table.sum(0), 1)
        logs = np.log(rates + 1e-3 * rates.mean(1, keepdims=True) + 1e-12)
        return np.vstack([logs, np.full(wide, UNSEEN)])


class _Rater:
    """Texts to languages; words beyond the model's are rated once and remembered as rows of a matrix."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.rows = dict(self.model.words)
        self.count = len(self.model.word_logs)
        self.logs = np.resize(self.model.word_logs, (self.count + REMEMBERED, self.model.word_logs.shape[1]))

    def _add(self, fresh: list[str]) -> None:
        """Backoff: the mean over a word's positions of the longest known n-gram that starts there."""
        get, found, sizes = self.model.grams.get, [], []
        for word in fresh:
            marked = f"<{word}>"
            sizes.append(len(marked))
            for at in range(len(marked)):
                for n in GRAM_SIZES:
                    k = get(marked[at : at + n])
                    if k is not None:
                        break
                found.append(-1 if k is None else k)
        sizes = np.array(sizes)
        means = np.add.reduceat(self.model.gram_logs[found], np.cumsum(sizes) - sizes) / sizes[:, None]
        while self.count + len(fresh) > len(self.logs):
            self.logs = np.resize(self.logs, (2 * len(self.logs), self.logs.shape[1]))
        self.logs[self.count : self.count + len(fresh)] = means
        self.count += len(fresh)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if self.count > len(self.model.word_logs) + REMEMBERED:
            self._forget()
        rows, fresh, at, out = self.rows, [], [], []
        for text in texts:
            words = _WORD.findall(text.lower()) if text else []
            own = list(map(rows.get, words))
            if None in own:
                for k, row in enumerate(own):
                    if row is None:
                        own[k] = rows.setdefault(words[k], self.count + len(fresh))
                        if own[k] == self.count + len(fresh):
                            fresh.append(words[k])
            letters = any(c.isalpha() for w in words for c in w)
            at.append(own if letters and self.model.languages else [])
        if fresh:
            self._add(fresh)
        for own in at:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            scores = self.logs[own].mean(0) * min(len(own), SHARPNESS)
            odds = np.exp(scores - scores.max())
            best = int(np.argmax(odds))
            out.append((self.model.languages[best], float(odds[best] / odds.sum())))
        return out


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> LanguageModel:
    """From columns doc_id, text, lang; rows with a null lang or text are left out."""
    usable = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = usable.count()
    if rows > sample_docs:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (sample_docs / rows)))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word")
    counts = usable.select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n")).persist()
    try:
        languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
        if not languages:
            return LanguageModel([], {}, {})
        marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
        grams = [
            F.transform(F.sequence(F.lit(1), F.length("m") - (n - 1)), lambda i, n=n: F.substring(F.col("m"), i, F.lit(n)))
            for n in GRAM_SIZES
        ]
        pieces = F.flatten(F.array(*[F.when(F.length("m") >= n, g).otherwise(F.array().cast("array<string>")) for n, g in zip(GRAM_SIZES, grams, strict=True)]))
        pieces = counts.withColumn("m", marked).select("lang", "n", F.explode(pieces).alias("word"))
        return LanguageModel(languages, _top(counts, languages, max_words), _top(pieces, languages, max_grams))
    finally:
        counts.unpersist()


def _top(counts: DataFrame, languages: list[str], most: int) -> dict[str, list[float]]:
    """The ``most`` most frequent entries with their counts by language; ties by code point."""
    by = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{k}") for k, lang in enumerate(languages)]
    top = counts.groupBy("word").agg(*by, F.sum("n").alias("total")).orderBy(F.desc("total"), "word").limit(most)
    return {r[0]: list(map(float, r[1:-1])) for r in top.collect()}


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` as struct ``d``, with lang_pred and score; reads the text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rater = _Rater(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rated = [r for a in range(0, len(texts), 200) for r in rater.predict(texts[a : a + 200])]
            made = [pa.array([r[0] for r in rated], pa.string()), pa.array([r[1] for r in rated], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *made], ["d", "lang_pred", "score"])

    whole = docs.select(F.struct("*").alias("d"), "text")
    return whole.mapInArrow(gives_back(rate), whole.select("d").schema.add("lang_pred", "string").add("score", "double"))


def language_report(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learns from the rows that are not held out, predicts every row."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))), sample_docs)
    rated = identify(docs.select("doc_id", "text"), model)
    return rated.select(F.col("d.doc_id").alias("doc_id"), held_out(F.col("d.doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language stays unknown or whose score is under ``least``."""
    return identify(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("d.*")
