"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lightloom.llm import collocations as C

from .corpus import documents, empty, frame


def phrases(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
        words = re.findall("[^\x20\x09]+", piece)
        for n in range(1, 6):
            for i in range(len(words) - n + 1):
                yield tuple(words[i : i + n])


def brute(rows, least, top=2000):
    f = {}
    for _, text, lang, *_ in rows:
        f.setdefault("und" if lang is None else lang, Counter()).update(phrases(text))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        often = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for q, c in often.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside[q[i : i + m]], c)
        found = []
        for p, a in often.items():
            if inside[p] < a:
                score, k = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def row(text, lang="en", doc_id=1):
    return (doc_id, text, lang, "s", 1, "x", 1, "k")


def mixed(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "İ", "nb sp", "x\x1cy", "'", "AB"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ; ", "\x0b", "!", "\r\n"]
    texts = ["".join(rng.choice(words) + rng.choices(ends, [30, 3, 3, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [row(t, rng.choice(["en", "en", "en", "de", None, "und", ""]), k) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("least", "shards"), [(5, 1), (40, 2)])
def test_random_texts(spark, least, shards):
    got = C.collocations(frame(spark, mixed(least)), least=least, shards=shards)
    assert sorted(map(tuple, got.collect())) == brute(mixed(least), least)


def test_phrases_first_found_in_the_last_scan(spark):
    """Phrases whose parts reach the limit one scan after another, each only in the last scan of its cycle."""
    rows = [row("a b c d e f", doc_id=k) for k in range(9)] + [row("a b c d g", doc_id=50 + k) for k in range(3)] + [row("a b", doc_id=90)] * 4
    assert sorted(map(tuple, C.collocations(frame(spark, rows), least=10, shards=3).collect())) == brute(rows, 10)


def test_blocks_of_long_texts(spark, monkeypatch):
    """Texts that are cut into slices and blocks, counted behind a full bitmap and behind none."""
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefg") + rng.choice(["", "", "", "."]) for _ in range(9000))
    texts = [text, "a" * 300_000 + " b", None, "", " .,\n", "a b c", "x y. z"]
    assert b"".join(C._slices(text.encode(), 50)) == text.encode() and len(list(C._slices(text.encode(), 50))) > 100
    blocks = C.coded(spark.createDataFrame([("en", t, 0) for t in texts], "lang string, text string, shard int"), block_words=40).collect()
    assert sum(r.words or 0 for r in blocks if r.shard == 0) > 100
    names = {xxhash.xxh64_intdigest(w.encode(), C._Codes("en", 0).seed): w for r in blocks if r.word for w in r.word.split("\n")}
    assert sum(r.words for r in blocks if r.shard == C._NAMES) == sum(len(p) == 1 for t in texts for p in phrases(t))
    every = np.full(1 << 13, 255, np.uint8)
    monkeypatch.setattr(C, "HELD", 100)
    counter, got = C._Counter(True, C.Found(16, every, every, [1, 2, 3, 4]), 5), Counter()
    for k, r in enumerate(r for r in blocks if r.shard == 0):
        counter.add(np.frombuffer(r.codes, np.uint64), r.words)
        if k % 50 == 0 or k + 1 == sum(r.shard == 0 for r in blocks):
            for out in counter.rows():
                for row in zip(*(out[c].to_pylist() for c in [*C.WORDS, "count"]), strict=True):
                    got[tuple(names[w % 2**64] for w in row[:-1] if w)] += row[-1]
    assert got == Counter(p for t in texts for p in phrases(t))
    none = np.zeros(1 << 13, np.uint8)
    assert not C.Found(16, every, none, [1]).both(np.arange(9, dtype=np.uint64)).size


def test_two_phrases_of_one_hash(monkeypatch):
    monkeypatch.setattr(C, "_mixed", lambda codes, first, n, size: np.zeros(size, np.uint64))
    words = np.array([[1, 2], [3, 4], [1, 2], [5, 6]], np.uint64)
    own, counts = C._summed(words, np.array([1, 1, 4, 1]))
    assert {tuple(w): c for w, c in zip(own.tolist(), counts.tolist(), strict=True)} == {(1, 2): 5, (3, 4): 1, (5, 6): 1}


def test_two_words_of_one_code(spark, monkeypatch):
    """All is done again with other codes."""
    rows = spark.createDataFrame([(C._NAMES, None, "en", w, 0) for w in "ab"], C._CODED)
    final = spark.createDataFrame([(7, 0, 0, 0, 0, 1, 9)], ", ".join(f"{w} long" for w in C.WORDS) + ", n int, count long")
    monkeypatch.setattr(C, "word_code", lambda lang, word, salt: C.F.lit(7).cast("long"))
    monkeypatch.setattr(C, "frequent_phrases", lambda *a: a)
    assert C._named(None, final, rows, 9, 5, 2, 0)[1:] == (9, 5, 2, 1)


def test_top_ties_and_repeats(spark):
    rows = [row(f"p{k} q{k}. r{k} s{k} t{k}") for k in range(40) for _ in range(5)]
    assert sorted(map(tuple, C.collocations(frame(spark, rows), least=5, top=25, shards=1).collect())) == brute(rows, 5, 25)


def test_counts_beyond_64_bits(spark):
    big = 3 * 10**12
    frequent = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big - 7), ("en", 2, "a b", big - 9)], "lang string, n int, phrase string, count long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, words long")
    got = C._scored(frequent, totals).first()
    assert got.score == 1000 * (big - 9) * 10**14 // (big * (big - 7))


def test_corpus_and_empty(spark):
    assert C.collocations(empty(spark), shards=1).count() == 0
    assert sorted(map(tuple, C.collocations(frame(spark), least=3, shards=1).collect())) == brute(documents(), 3)


def test_rare_pairs_are_not_shuffled(spark, monkeypatch):
    """Pairs of frequent words that stay below the limit are left out by the counts of their buckets, in whatever shard they stand."""
    rng = random.Random(5)
    words = [f"v{k}" for k in range(150)]
    rows = [row(" ".join(rng.choice(words) for _ in range(60)) + ". mit p q r x" + rng.choice(["", " y"]), doc_id=k) for k in range(400)]
    runs, write = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name, **options: (out := write(df, name, **options), runs.append(out.filter("w2 <> 0 and w3 = 0").count()) if name == "phrase-run" else None)[0])
    assert sorted(map(tuple, C.collocations(frame(spark, rows), least=30).collect())) == brute(rows, 30)
    assert sum(runs) < 200  # of about 14,000 different pairs


def test_pair_buckets(spark, monkeypatch):
    """Buckets of pairs in blocks with repeated words, in several parts of a task and several tasks, against counting."""
    monkeypatch.setattr(C, "HELD_PAIRS", 50)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde") + rng.choice([" ", " ", " ", ". "]) for _ in range(400)) for _ in range(6)]
    blocks = C.coded(spark.createDataFrame([("en", t, k % 2) for k, t in enumerate(texts)], "lang string, text string, shard int").repartition(3), block_words=40)
    rows = C.stored(blocks, "codes")
    counts = Counter(p for t in texts for p in phrases(t) if len(p) == 2)
    codes = C._Codes("en", 0)
    for least in (1, 60, 10**6):
        often = C.Found(16, None, None, [], C._pair_buckets(rows, least, 17)).often
        for pair, n in counts.items():
            code = np.array([codes[w.encode()] for w in pair], np.uint64)
            assert bool(often(C._mixed(code, 0, 2, 1))[0]) == (n >= least)
