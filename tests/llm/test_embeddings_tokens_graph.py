import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lightloom.llm import embeddings, graph, rangecoder, tokens

from .corpus import documents, empty, frame

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = graph.connected_components(spark.createDataFrame([*edges, (7, None)], "u long, v long"))
    rows = [(r.node, r.root) for r in got.collect()]
    assert len(rows) == len({n for n, _ in rows}) and dict(rows) == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    vectors = [c + rng.normal(size=32) * s for c in centres for s in (0, 0.05, 0.1, 0.2, 0.25, 0.3)]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(900, rows[7][1], 1), (901, rows[7][1], 2), (902, None, 0), (903, [0.0] * 32, 0), (904, [float("nan")] * 32, 0), (905, [None] * 32, 0), (906, [], 0), (907, [float("inf")] + [1.0] * 31, 0)]
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i < 902}
    links = {i: {j for j in good if j != i and good[i] @ good[j] >= 0.95} for i in good}
    got = {r.vec_id: r for r in embeddings.embedding_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    found, there = sum(got[i].n_links for i in good), sum(map(len, links.values()))
    assert 0.9 * there <= found <= there
    assert got[900].n_links == len(links[900]) and got[900].component_id <= 7
    for i in range(902, 908):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.embedding_report(none).count() == 0


@pytest.mark.parametrize("large,block", [(4096, 2000), (0, 7)])
def test_embedding_families(spark, monkeypatch, large, block):
    """A family of near copies with copies of its own, and values beyond float: exact counts, with blocks of any size."""
    monkeypatch.setattr(embeddings, "LARGE", large)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    vectors = [centre + 0.12 * rng.normal(size=16) for _ in range(60)] + [rng.normal(size=16) for _ in range(60)]
    vectors += [vectors[3] * 1e300, vectors[5], vectors[5]]
    rows = [(i, [float(x) for x in v], "x", None) for i, v in enumerate(vectors)]
    unit = np.array([v / np.abs(v).max() for v in vectors])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(len(unit), dtype=bool)
    got = {r.vec_id: r for r in embeddings.embedding_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, value string, root int")).collect()}
    assert all(got[k].n_links == n for k, n in enumerate(links.sum(1)))
    reach = np.linalg.matrix_power(links.astype(float) + np.eye(len(unit)), 16) > 0
    assert all(got[k].component_id == int(np.flatnonzero(r)[0]) for k, r in enumerate(reach))


@pytest.mark.parametrize("shared", [0.5, 0.8, 0.93])
def test_embeddings_with_a_common_direction(spark, shared):
    """Vectors of a mean cosine of ``shared``, in pairs at cosines from 0.95 to 0.96: both the tables and all pairs."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    own = rng.normal(size=(600, 64))
    own[:, 0] = 0
    first = np.sqrt(1 - shared) * unit(own)
    first[:, 0] = np.sqrt(shared)
    way = rng.normal(size=first.shape)
    way = unit(way - (way * first).sum(1, keepdims=True) * first)
    cosine = rng.uniform(0.9505, 0.96, (600, 1))
    vectors = np.vstack([first, cosine * first + np.sqrt(1 - cosine**2) * way]).astype(np.float32)
    good = unit(vectors.astype(float))
    links = (good @ good.T >= 0.95) & ~np.eye(len(good), dtype=bool)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    got = {r.vec_id: r.n_links for r in embeddings.embedding_report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert 0.9 * links.sum() <= sum(got.values()) <= links.sum()
    assert all(got[k] <= n for k, n in enumerate(links.sum(1)))


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000, 300_000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000)
    ids[n // 2 :] = ids[: n - n // 2]
    lengths = np.array([n // 3, n - n // 3])
    block = rangecoder.encode_block(ids, lengths, 50_257)
    back, sizes = rangecoder.decode_block(block)
    assert (back == ids).all() and (sizes == lengths).all()
    if n > 1000:
        assert len(block) < 2 * n
        damaged = bytearray(block)
        damaged[-5] ^= 1
        with pytest.raises(ValueError):
            rangecoder.decode_block(bytes(damaged))
    with pytest.raises(ValueError):
        rangecoder.decode_block(block[:-1])


def test_pieces_equal_whole_texts():
    encoder = tokens.PieceEncoder(BPE)
    texts = ["", "a", " a", "a ", "a  b", "a\nb c", "x \n y", "it's don't  we'll", "é à b", "<|endoftext|> x", "a\x1cb c", "　a b", None, "b a", "word word word"]
    ids, lengths = encoder.encode(texts)
    ends = np.cumsum(lengths)
    for text, a, b in zip(texts, ends - lengths, ends, strict=True):
        assert list(ids[a:b]) == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def _same_ids(encoder, texts):
    ids, lengths = encoder.encode(texts)
    ends = np.cumsum(lengths)
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w, a, b in zip(texts, whole, ends - lengths, ends, strict=True) if [*w.ids, 0] != ids[a:b].tolist()] == []


def test_every_letter_below_the_limit():
    """Every code point up to U+024F and a few beyond: alone, in a word, after a space, before each mark and line end."""
    forms = ["{}", "a{}b", "x {} y", "the width is 5 {}m wide", "n{} 5", "{0}{0}", *[f"w{{0}}{m} z {{0}}{m}" for m in ".,;:!?\n"], "{}\nq", "q\n{}\nq", "'{}s", "{}'s"]
    _same_ids(tokens.PieceEncoder(BPE), [f.format(chr(c)) for c in range(0x260) for f in forms])


def test_random_texts_of_all_letters():
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x80, 0x260)] + list("ªºµß'abcxyz ") * 12 + list(" .,;:!?\n") * 8 + ["  ", "\u00a0", "\u2028", "中", "😀"]
    encoder = tokens.PieceEncoder(BPE, remembered=3000)
    for _ in range(40):
        _same_ids(encoder, ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(500)])


def test_token_files(spark, tmp_path):
    encoder = tokens.PieceEncoder(BPE)
    rows = sorted(documents(), key=lambda r: r[0])
    path = str(tmp_path / "tokens")
    tokens.write_tokens(frame(spark), path, BPE)
    got = sorted(tokens.read_tokens(spark.read.parquet(path)).collect(), key=lambda r: r.start)
    start = 0
    assert len(got) == len(rows)
    for r, row in zip(got, rows, strict=True):
        ids = [*encoder.tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (row[0], start, len(ids), crc, ids)
        start += len(ids)
    assert tokens.token_report(empty(spark), BPE).count() == 0


def test_owners_of_values_without_search():
    """Order 0 names the id of a value by a table, which follows its counts; the same as a search in the cumulated counts."""
    model = rangecoder._Model(500, 4)
    rng = np.random.default_rng(3)
    for _ in range(3):
        values = np.arange(int(model.total))
        assert (model.owners(values) == np.searchsorted(model.cum, values, side="right") - 1).all()
        model.count += rng.integers(0, 40, 500)
        model._order0_up()


def test_pieces_are_numbered_once():
    """Pieces met for the first time are numbered as they are looked up; one that begins or ends with white space is told, not numbered."""
    pieces = tokens._Pieces({"a": 1}, 2)
    assert [pieces[p] for p in ("a", "b", "c", "b")] == [1, 2, 3, 2] and pieces.fresh == ["b", "c"] and not pieces.odd
    assert [pieces[p] for p in ("", "x\n", "\x1cx")] == [0, 0, 0] and pieces.odd and pieces.fresh == ["b", "c"]
