"""The Merkle manifest against a plain walk over sorted rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lightloom.llm import merkle

from .corpus import documents, empty, frame


def h(x):
    return hashlib.sha256(x.encode("utf-8")).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(map(told, (doc_id, source, lang, n_chars, text))))


def tree(nodes):
    """(top, siblings (left, right) of each node, level by level)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, path in enumerate(paths):
            a = at[k] // 8 * 8
            path.append(("".join(level[a : at[k]]), "".join(level[at[k] + 1 : a + 8])))
            at[k] //= 8
        level = [h("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by_lang = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by_lang.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n_chars, lower(text)) if touched else own))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops = {}
    for lang in langs:
        by_lang[lang].sort()
        tops[lang] = tree([r[2] for r in by_lang[lang]])
    root, high = tree([tops[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, high, strict=True):
        for (has, doc_id, own, told), low in zip(by_lang[lang], tops[lang][1], strict=True):
            at = told
            for left, right in low + up:
                at = h(left + at + right)
            out.append((doc_id if has else None, own, tops[lang][0], root, h("".join(a + b for a, b in low + up)), at, at == root))
    return sorted(out, key=str)


def check(spark, rows):
    got = merkle.merkle_report(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def row(doc_id, text="Some Text", lang="en", source="s", n_chars=1):
    return (doc_id, text, lang, source, n_chars, "x", 1, "k")


def test_corpus(spark):
    check(spark, documents())


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 4100])
def test_sizes(spark, n):
    check(spark, [row(k * 3) for k in range(n)] + [row(7, lang="de")])


def test_ids_far_apart_and_below_zero(spark):
    ids = [-(1 << 63), (1 << 63) - 1, -1, 0, 5, 64, 63, 1 << 40, (1 << 40) + 1, -(1 << 50), None, None]
    check(spark, [row(i, text=f"T{k}") for k, i in enumerate(ids)])


def test_repeated_ids_and_rows(spark):
    rows = [row(5, text=f"Text {k % 30}") for k in range(70)] + [row(k) for k in range(10)] + [row(5, lang=None)] * 3 + [row(None, text=None, source=None, n_chars=None)] * 9
    check(spark, rows)


def test_many_languages(spark):
    check(spark, [row(k, lang=f"l{k % 75}") for k in range(200)] + [row(1, lang=""), row(1, lang="é"), row(1, lang=None)])


def test_empty_table_and_clashing_columns(spark):
    assert merkle.merkle_report(empty(spark)).count() == 0
    rows = frame(spark).withColumns({n: F.lit("x") for n in ("tree", "pos", "own", "size", "word", "bit", "path", "leaf", "n")})
    assert sorted(map(tuple, merkle.merkle_report(rows).collect()), key=str) == brute(documents())
