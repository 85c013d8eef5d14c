import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightloom.llm import decontaminate, language, license_rules, licenses, lines, lm, minhash, mixing, substrings

from .corpus import documents, empty, frame

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def lower(text):
    return (text or "").translate(LOWER)


def test_mixing(spark):
    rows = documents()
    got = mixing.plan_mixture(frame(spark)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(PLAIN.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, target, open_ = sum(size.values()), {}, set(names)
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= longest for s in names)
    assert sum(taken.values()) <= budget
    again = sorted(map(str, mixing.plan_mixture(frame(spark).repartition(3)).collect()))
    assert again == sorted(map(str, got))
    mixed = mixing.mix_documents(frame(spark))
    assert mixed.columns == frame(spark).columns
    plan = Counter()
    for r in got:
        if r.size:
            plan[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +plan
    assert mixing.plan_mixture(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_lines(spark, batches, fanout):
    rows = documents()
    keys = [[x.strip(" \t\n\x0b\f\r").translate(LOWER) for x in (r[1] or "").split("\n")] for r in rows]
    docs = Counter(k for own in keys for k in set(own) if k)
    got = Counter((r.d.doc_id, r.n_lines, r.n_dropped, r.kept) for r in lines.dedup_lines(frame(spark), 10, 1, batches, fanout).collect())
    want = Counter()
    for r, own in zip(rows, keys, strict=True):
        stay = [x for x, k in zip((r[1] or "").split("\n"), own, strict=True) if docs[k] < 10]
        want[r[0], len(own), len(own) - len(stay), "\n".join(stay)] += 1
    assert got == want
    assert lines.line_report(empty(spark)).count() == 0
    assert lines.drop_frequent_lines(frame(spark)).columns == frame(spark).columns


def test_rows_that_share_an_id_are_one_document(spark):
    """7 is a copy of 5 and, in another row, of 9: all are one group."""
    base, other = " ".join(f"w{k}" for k in range(30)), " ".join(f"v{k}" for k in range(30))
    docs = spark.createDataFrame([(5, base), (7, base), (7, other), (9, other)], "doc_id long, text string")
    got = minhash.minhash_report(docs, 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False)]
    assert [r.doc_id for r in minhash.keep_one_of_each(docs, 3, 85).collect()] == [5]


def brute_components(rows, width, percent):
    sets = {}
    for r in rows:
        w = PLAIN.findall(lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width,percent,small", [(3, 85, 32), (5, 80, 2)])
def test_minhash(spark, monkeypatch, width, percent, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    want = brute_components(documents(), width, percent)
    got = minhash.minhash_report(frame(spark), width, percent).collect()
    assert len(got) == len(documents())
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = minhash.keep_one_of_each(frame(spark), width, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert minhash.minhash_report(empty(spark), width, percent).count() == 0


def test_substrings(spark):
    rows = documents() + [(300, "a b " * 40, "en", "s", 1, "", 0, ""), (None, "q " * 25, "en", "s", 1, "", 0, "")]
    first, want = {}, {}
    for doc_id, text in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows}):
        w = PLAIN.findall(text)
        gone = set()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (doc_id, i)) != (doc_id, i):
                gone |= set(range(i, i + 20))
        want[doc_id] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = substrings.substring_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id]
    assert substrings.substring_report(empty(spark)).count() == 0
    assert substrings.drop_repeated_passages(frame(spark)).columns == frame(spark).columns


def test_substrings_come_from_the_automaton(spark, monkeypatch):
    """With an automaton that finds nothing only whole copies go; with small shards and chunks nothing changes."""
    docs = frame(spark).select("doc_id", "text").distinct()
    got = substrings.substring_report(docs).collect()
    whole = sorted(map(tuple, got), key=str)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 30)
    monkeypatch.setattr(substrings, "CHUNK_WORDS", 200)
    monkeypatch.setattr(substrings, "_PART", 7)
    assert sorted(map(tuple, substrings.substring_report(docs).collect()), key=str) == whole
    shard = substrings.Shard([(1, 0, b"a b c d e f"), (2, 4, b"x b c d e y")], 4)
    rows = lambda *texts: [(o, start, words, len(words.split())) for o, start, words in texts]
    assert shard.removed(rows((9, 0, b"q b c d e r a b c d"))) == [(9, 1, 5), (9, 6, 10)]
    assert shard.removed(rows((1, 0, b"a b c d e f"))) == []
    assert shard.removed(rows((1, 5, b"z a b c d e f"), (3, 2, b"a b c d"))) == [(1, 6, 12), (3, 2, 6)]
    assert shard.removed(rows((4, 0, b"q q a b"), (5, 0, b"c d q q"))) == []  # a window in two regions is none
    nothing = lambda documents, parts, window: documents.select("o", F.lit(0).alias("low"), F.lit(0).alias("high")).limit(0)
    monkeypatch.setattr(substrings, "_streamed", nothing)
    assert sum(r.n_removed for r in substrings.substring_report(docs).collect()) < sum(r.n_removed for r in got)


def test_substrings_send_a_region_to_few_shards(spark, monkeypatch):
    """A phrase that passages of all shards have does not send its regions to all of them."""
    phrases = [f"p{k} of the and to in".split() for k in range(3000)]
    code = lambda words: substrings._rolling(substrings.word_codes([w.encode() for w in words]), substrings.GRAM, 0x9E3779B97F4A7C15)[0]
    phrase = min(phrases, key=code)  # so that it is the anchor of all windows with it
    rows = []
    for k in range(40):
        passage = [f"a{k}x{i}" for i in range(20)] + phrase + [f"b{k}x{i}" for i in range(20)]
        rows += [(2 * k + j, " ".join([f"h{k}x{j}", *passage, f"t{k}x{j}"])) for j in (0, 1)]
    docs, streamed, sent = spark.createDataFrame(rows, "doc_id long, text string"), substrings._streamed, []

    def counted(documents, parts, window):
        sent.append((documents.count(), parts.select("shard").distinct().count()))
        return streamed(documents, parts, window)

    monkeypatch.setattr(substrings, "_streamed", counted)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 30)
    for common in (substrings.COMMON_PASSAGES, 5):
        monkeypatch.setattr(substrings, "COMMON_PASSAGES", common)
        got = substrings.substring_report(docs).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(i, 48, 46 * (i % 2)) for i in range(80)]
    assert sent[0][1] > 20 and sent[0][0] <= 4 * len(rows)


@pytest.mark.parametrize("bounds,kind", [((8, 40, 300), "bigint"), ((1 << 12, 1 << 30, 1 << 20), "bigint"), ((1 << 12, 1 << 30, 1 << 21), "struct<o:bigint,start:int>")])
def test_places_of_windows_keep_their_order(spark, bounds, kind):
    parts, rows, words = bounds
    want = [(p << 33 | r, s) for p in (0, 1, parts - 1) for r in (0, 5, rows - 1) for s in (0, 7, words - 1)]
    place, o, start = substrings._places_of_windows(*bounds)
    got = spark.createDataFrame(want[::-1], "o long, start int").select(place("o", F.col("start")).alias("f"))
    assert got.dtypes == [("f", kind)]
    assert list(map(tuple, got.orderBy("f").select(o("f"), start("f")).collect())) == want


@pytest.mark.parametrize("most", [1_000_000, 7])
def test_decontamination(spark, most):
    rows = documents()
    words = [ALNUM.findall(lower(r[1])) for r in rows]
    bench = [(1, " ".join(words[0][-30:])), (2, "Shared line OF"), (3, None), (4, ""), (5, "no such words in it"), (1, "again the same"), (None, "edit3")]
    grams = defaultdict(set)
    for i, text in bench:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[k : k + 10])].add(i)
    got = decontaminate.contamination_report(frame(spark), spark.createDataFrame(bench, "item_id long, text string"), 10, most).collect()
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        hit, items = set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items |= {str(i) for i in owners if i is not None}
        want[r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(map(tuple, got)) == want
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination_report(frame(spark), nothing).collect())
    assert decontaminate.contamination_report(empty(spark), nothing).count() == 0


def test_decontamination_cuts(spark):
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A, b; c! d"), (2, "x"), (3, None)], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in decontaminate.remove_contaminated(docs, bench, how="spans").collect()}
    assert cut == {1: "A, ! d", 2: "x", 3: None}
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()} == {2, 3}


def test_licenses(spark):
    rows = documents() + [(400, "MIT  License, GNU Lesser General Public License v3; Apache-License", "en", "s", 1, "", 0, "")]
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    got = licenses.license_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        w = ALNUM.findall(lower(text))
        at = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        r, starts = by_id[doc_id], [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in at}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "lgpl-3.0" in by_id[400].labels.split(",") and "gpl-3.0" not in by_id[400].labels.split(",")  # inside the longer hit
    assert licenses.license_report(empty(spark)).count() == 0


def _brute_licenses(text):
    """All hits of all rules in a text, then those that no rule as good covers, in plain Python."""
    norm = f" {' '.join(ALNUM.findall(lower(text)))} "
    hits = []
    for k, rule in enumerate([license_rules.Rule(*b) for b in license_rules.BASE] + license_rules.rules()):
        for m in re.finditer(f"(?<= )(?:{rule.regex})(?= )", norm):
            start = norm[: m.start()].count(" ") - 1
            hits.append((start, start + m.group().count(" ") + 1, rule.priority, k, rule.label))
    kept = []
    for h in hits:
        before = lambda o, h=h: (o[0], -o[1], o[2], o[3]) < (h[0], -h[1], h[2], h[3])
        if h[2] == 0 or not any(0 < o[2] <= h[2] and o[1] >= h[1] and before(o) for o in hits):
            kept.append(h)
    score = max((license_rules.CONFIDENCE[h[2]] for h in kept), default=0.0)
    return ",".join(sorted({h[4] for h in kept})), score


def test_licenses_against_brute_force(spark):
    """Labels and scores of mixed, overlapping and very many hits."""
    rng = np.random.default_rng(6)
    pieces = [" ".join(_examples(_parse(r.regex))[0].split()) for r in license_rules.rules() if r.priority != 2]
    pieces += ["licensed under the MIT license", "Apache License, Version 2.0", "GNU Lesser General Public License v3", "some plain words", "\u00c4 under \u0130"]
    texts = [" ".join(rng.choice(pieces, int(rng.integers(1, 6)))) for _ in range(150)]
    texts += ["mit license, " * 3000, "licensed under the mit license " * 500]
    got = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.labels, r.score) == _brute_licenses(texts[r.doc_id]), texts[r.doc_id][:300]


def _parse(regex):
    from re import _parser

    return _parser.parse(regex)


def _examples(tree):
    """For every way through a parsed regex, a text that it matches; repeats as few times as they may, or once."""
    out = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            own = [chr(value)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            some = _examples(value[2])
            own = [x * value[0] for x in some] if value[0] else ["", *some]
        elif name == "SUBPATTERN":
            own = _examples(value[3])
        elif name == "BRANCH":
            own = [x for b in value[1] for x in _examples(b)]
        elif name == "IN":
            own = [{"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "0" if "DIGIT" in str(v) else "x"}[str(k)](v) for k, v in value]
        else:
            assert name == "ANY"
            own = ["x"]
        out = [a + b for a in out for b in dict.fromkeys(own)]
    return out


def test_license_keywords_are_implied_by_their_rules():
    from re import _parser

    for rule in [license_rules.Rule(*b) for b in license_rules.BASE] + license_rules.rules():
        name = re.sub(r"^\(\?:licen\[cs\]ed\|.*?\(\?: the\)\?(?= [^(]| \()", "licensed under", rule.regex) if rule.priority == 2 else rule.regex
        for text in _examples(_parser.parse(name)):
            assert rule.keyword in f" {text} ", (rule, text)
            assert any(g in f" {text} " for g in license_rules.GATES), (rule, text)


def test_license_full_names(spark):
    names = {"mit": "expat", "isc": "internet systems consortium", "libpng": "png reference library", "wtfpl": "do what the fork you want to public"}
    rows = [(k, f"this is licensed under the {name} license") for k, name in enumerate(names.values())]
    got = licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.score) for r in got} == {k: (label, 0.9) for k, label in enumerate(names)}


def test_language_of_a_run_without_spaces():
    """The end of a run counts, not its first 64 letters alone."""
    model = language.LanguageModel(["x", "y"], {}, {"a": [99.0, 1.0], "b": [1.0, 99.0]})
    rated = language._Rater(model).predict(["a" * 64 + "b" * 20_000, "b" * 64 + "a" * 20_000])
    assert [r[0] for r in rated] == ["y", "x"] and min(r[1] for r in rated) > 0.9


def test_language_held_out(spark):
    """Held-out texts of three made languages, of which nine in ten or more must be right; no held-out row is learnt from."""
    rng = np.random.default_rng(8)
    letters = {"aa": "aeioulnt", "bb": "aekrszcy", "cc": "uoghmbdp"}
    words = {k: ["".join(rng.choice(list(v), int(rng.integers(2, 8)))) for _ in range(400)] for k, v in letters.items()}
    rows = [(i, " ".join(rng.choice(words[k], int(rng.integers(4, 40)))), k) for i in range(300) for k in [("aa", "bb", "cc")[i % 3]]]
    truth = {r[0]: r[2] for r in rows}
    got = language.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    spoilt = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else k) for i, t, k in rows]
    again = language.language_report(spark.createDataFrame(spoilt, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in again} == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_language(spark):
    got = language.language_report(frame(spark)).collect()
    truth = {r[0]: r[2] for r in documents()}
    assert len(got) == len(documents())
    rated = [r for r in got if r.doc_id < 60]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rated) >= 0.9 * len(rated)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred == "und") == (r.doc_id in (200, 201, 202, 203))
    assert language.language_report(empty(spark)).count() == 0
    unlabelled = frame(spark, [(*r[:2], None, *r[3:]) for r in documents()])
    assert {r.lang_pred for r in language.language_report(unlabelled).collect()} == {"und"}
    kept = language.keep_identified(frame(spark), language.fit(frame(spark)))
    assert kept.columns == frame(spark).columns and kept.count() >= 60


@pytest.mark.parametrize("most", [100_000, 5])
def test_lm(spark, monkeypatch, most):
    monkeypatch.setattr(lm, "MAX_WORDS", most)
    rows = documents()
    tokens = [[*PLAIN.findall(lower(r[1])), None] for r in rows]
    held = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    c = Counter(w for own, h in zip(tokens, held, strict=True) if not h for w in own)
    n, v = sum(c.values()), len(c)
    got = lm.lm_report(frame(spark)).collect()
    want = {r[0]: (h, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) for r, own, h in zip(rows, tokens, held, strict=True)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9) and r.score <= 1e-9
    assert lm.lm_report(empty(spark)).count() == 0


def test_lm_probabilities_sum_to_one(spark, monkeypatch):
    """Over the end, all numbered words, and all others as one, after some history; with classes of a few words each."""
    monkeypatch.setattr(lm, "WIDE", 4)
    monkeypatch.setattr(lm, "BANDS", 2)
    monkeypatch.setattr(lm, "CLASSES", lm.CLUSTERS * 3 + 1)
    docs = frame(spark).select(F.struct("doc_id").alias("d"), "text", F.lit(True).alias("learn"))
    vocab = lm.vocabulary(lm.word_counts(docs), docs.count(), 60)
    assert 20 < len(vocab.numbers) <= 60
    model = lm.fit(lm.numbered(docs, vocab).withColumn("rid", F.monotonically_increasing_id()), vocab)
    assert np.abs(model.class_weights).max() > 0.01 and np.abs(model.word_weights).max() > 0.01
    ends = np.arange(len(vocab.numbers) + 2)
    for history in ([2, 3], [5], [lm.RARE, 9]):
        rows = np.stack([[*history, e] for e in ends]).astype(np.int32)
        codes = model.codes[rows]
        codes[rows == lm.RARE] = 12345
        starts = np.arange(len(ends)) * rows.shape[1]
        logs = lm.log_probabilities(lm._Run(starts, rows.ravel(), codes.ravel()), model).reshape(rows.shape)[:, -1]
        assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-4)  # the rare words' class as one outcome


def test_lm_step_is_the_gradient():
    """A mini-batch step moves every feature's weights against its mean residual, here counted token by token."""
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(size=(8, 5)).astype(np.float32), rng.normal(size=5).astype(np.float32)
    slots, target = rng.integers(0, 8, (2, 40)), rng.integers(0, 5, 40)
    want = weights.astype(float)
    for k in range(2):
        step, seen = np.zeros((8, 5)), np.zeros(8)
        now = weights.astype(float)
        for t in range(40):
            logits = now[slots[0, t]] + now[slots[1, t]] + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[t]] -= 1
            step[slots[k, t]] += p
            seen[slots[k, t]] += 1
        want -= lm.RATE * step / (seen + 5)[:, None] * (seen > 0)[:, None]
    lm.descend(weights, slots, bias, target)
    assert np.allclose(weights, want, atol=1e-5)


def test_lm_learns_history(spark):
    """Texts in which each word names the next: held out, the model beats the base by far."""
    words = [f"w{k}" for k in range(30)]
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        at = int(rng.integers(30))
        text = []
        for _ in range(60):
            text.append(words[at])
            at = (7 * at + 3) % 30
        rows.append((i, " ".join(text)))
    got = [r for r in lm.lm_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got) and len(got) > 20
