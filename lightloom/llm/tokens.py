"""Token-ID output: texts to ids of a public tokenizer, ids to range-coded blocks in Parquet shards, and back.

Documents are dealt by ranges of doc_id and sorted, each range is one shard; a shard's blocks hold whole documents.
The blocks are this module's own binary format (see ``rangecoder``); Parquet carries them so that Spark's commit protocol
makes shards whole or absent and any store that Spark reaches can hold them. Reading needs no shuffle of ids: where a
document starts follows from the blocks' token counts.

Tokenizing remembers the ids of space-separated pieces: a byte-level pattern never joins across a single space between two
non-space characters, so a text is the ids of its pieces; other texts are encoded whole.

Defined results: null text is the empty text (the end id only); strings of special tokens in a text are ordinary text;
null doc_ids come first; rows that repeat are documents of their own; an empty table gives no shard rows.
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gives_back, stored
from .rangecoder import decode_block, encode_block

BLOCK_TOKENS = 1 << 20
REMEMBERED = 300_000
#: Up to so many blocks (24 bytes each), the table of where they start goes to every task; more are joined by shuffle.
BROADCAST_BLOCKS = 1_000_000
END_ID = 0
BLOCK_SCHEMA = "shard int, block int, n_tokens long, doc_ids array<long>, data binary"


def _separable(piece: str) -> bool:
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


def _byte_letters() -> dict[int, str]:
    """Letters beyond ASCII and below ``_BEYOND`` to the letters that stand for their bytes in a byte-level vocabulary."""
    return {c: "".join(chr(b) if 161 <= b <= 172 or b >= 174 else chr(256 + _HIDDEN.index(b)) for b in chr(c).encode()) for c in range(0x80, ord(_BEYOND))}


#: Bytes that a byte-level vocabulary shows as letters from U+0100 on, since they have no visible form of their own.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
#: Words with letters from here on go to the whole tokenizer.
_BEYOND = "\u0250"
_SPACE = chr(256 + _HIDDEN.index(32))
_PUNCTUATION = ".,;:!?"


class _Pieces(dict):
    """Pieces to numbers. A piece met for the first time is numbered and put into ``fresh``; ``odd`` tells that one can't be taken on
    its own (it is empty or begins or ends with white space)."""

    def __init__(self, known: dict[str, int], pieces: int):
        super().__init__(known)
        self.pieces, self.fresh, self.odd = pieces, [], False

    def __missing__(self, piece: str) -> int:
        if not piece or piece.strip() != piece:
            self.odd = True
            return 0
        at = self[piece] = self.pieces
        self.pieces += 1
        self.fresh.append(piece)
        return at


class PieceEncoder:
    """Texts to ids; piece 0 is the end of a document.

    A piece of Latin letters, with or without one punctuation mark at its end, is one word of the tokenizer's pattern (and
    the mark another, as is a single line end between such words), so it goes to the tokenizer's model without the pattern; other pieces go to the whole tokenizer.
    Of the pieces remembered, those used least go first.
    """

    def __init__(self, tokenizer_path: str, end_id: int = END_ID, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.begins = np.zeros(self.vocabulary, bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(_SPACE)]] = True
        self.marks = {c: self._ids(c).tolist() for c in _PUNCTUATION}
        self.letters, self.line_end = _byte_letters(), self._ids("\n").tolist()
        self.end_id, self.remembered = end_id, remembered
        self.known = _Pieces({}, 1)
        self.pool, self.used = np.full(1024, end_id, np.int32), 1
        self.offset, self.length, self.uses, self.pieces = np.zeros(1024, np.int64), np.ones(1024, np.int64), np.zeros(1024, np.int64), 1

    def _forget(self) -> None:
        """Half of the pieces that may be remembered stay, the most used."""
        often = np.flatnonzero(self.uses[1 : self.pieces] > 1)
        if len(often) > self.remembered // 2:
            often = np.sort(often[np.argsort(-self.uses[1 + often], kind="stable")[: self.remembered // 2]])
        names, kept = list(self.known), np.r_[0, 1 + often]
        lengths, offsets = self.length[kept], self.offset[kept]
        begins = np.cumsum(lengths) - lengths
        pool = self.pool[np.repeat(offsets - begins, lengths) + np.arange(int(lengths.sum()))]
        self.known = _Pieces({names[k]: at for at, k in enumerate(often.tolist(), 1)}, len(kept))
        self.pool, self.used, self.pieces = pool, len(pool), len(kept)
        self.offset, self.length, self.uses = begins, lengths, self.uses[kept] // 2

    def _room(self, pieces: int, ids: int) -> None:
        while self.used + ids > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        while self.pieces + pieces > len(self.length):
            wide = 2 * len(self.length)
            self.offset, self.length, self.uses = np.resize(self.offset, wide), np.resize(self.length, wide), np.resize(self.uses, wide)

    def _put(self, numbers: np.ndarray, flat: list[int] | np.ndarray, lengths: list[int]) -> None:
        """Ids of the pieces with these numbers, one after another."""
        sizes = np.array(lengths, np.int64)
        self.pool[self.used : self.used + len(flat)] = flat
        self.length[numbers], self.offset[numbers], self.uses[numbers] = sizes, self.used + np.cumsum(sizes) - sizes, 0
        self.used += len(flat)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _spaced(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces with a space before each: encoded in one go, cut where an id begins with the space."""
        ids = self._ids(" " + " ".join(pieces))
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(pieces):
            return [self._ids(" " + p).tolist() for p in pieces]
        flat, ends = ids.tolist(), [*starts[1:].tolist(), len(ids)]
        return [flat[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]

    def _word(self, piece: str, lead: str) -> list[int] | None:
        """Ids of ``lead`` and a piece of letters with at most one mark after them; None for other pieces."""
        mark = self.marks.get(piece[-1]) if piece else None
        word = piece[:-1] if mark else piece
        if not word.isalpha():
            return None
        if not word.isascii():
            if max(word) >= _BEYOND:
                return None
            word = word.translate(self.letters)
        ids = [t.id for t in self.model.tokenize(lead + word)]
        return ids + mark if mark else ids

    def _lines(self, piece: str, lead: str) -> list[int] | None:
        """As ``_word`` for words with a single line end between them."""
        out = []
        for k, line in enumerate(piece.split("\n")):
            ids = self._word(line, "" if k else lead)
            if ids is None:
                return None
            out += self.line_end + ids if k else ids
        return out

    def _add_fresh(self, pieces: list[str]) -> None:
        flat, lengths, numbers, rest = [], [], [], []
        tokenize = self.model.tokenize
        for at, piece in enumerate(pieces, self.pieces):
            if piece.isalpha() and piece.isascii():  # most are, and spare the calls
                ids = [t.id for t in tokenize(_SPACE + piece)]
            else:
                ids = self._lines(piece, _SPACE) if "\n" in piece else self._word(piece, _SPACE)
            if ids is None:
                rest.append(at)
                continue
            flat += ids
            lengths.append(len(ids))
            numbers.append(at)
        others = []
        for a in range(0, len(rest), 4096):
            others += self._spaced([pieces[at - self.pieces] for at in rest[a : a + 4096]])
        more = list(chain.from_iterable(others))
        self._room(len(pieces), len(flat) + len(more))
        self._put(np.array(numbers, np.int64), flat, lengths)
        self._put(np.array(rest, np.int64), more, list(map(len, others)))
        self.pieces += len(pieces)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, lengths)."""
        collects = gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.remembered:
            self._forget()
        known, order, counts, single = self.known, [], [], []
        for text in texts:
            head, row = None, []
            if text:
                head, *tail = text.split(" ")
                known.odd = not _separable(head)
                row = [] if known.odd else list(map(known.__getitem__, tail))
                if known.odd:
                    head, row = text, []
            if head is not None:  # begins the text, has no space before it
                single.append(head)
                order.append(-len(single))
            order += row
            order.append(0)
            counts.append(len(row) + 1 + (head is not None))
        if known.fresh:
            self._add_fresh(known.fresh)
            known.fresh = []
        at, used = self.pieces, self.used
        if single:
            made = [self._lines(t, "") or self._ids(t) for t in single]
            self._room(len(made), sum(map(len, made)))
            self._put(np.arange(at, at + len(made)), np.concatenate(made), list(map(len, made)))
        rows = np.array(order, np.int64)
        if single:
            rows = np.where(rows < 0, at - 1 - rows, rows)
        lengths = self.length[rows]
        begins = np.cumsum(lengths) - lengths
        ids = self.pool[np.repeat(self.offset[rows] - begins, lengths) + np.arange(int(lengths.sum()))]
        ends = np.cumsum(counts)
        self.used, self.pieces = used, at  # numbers of text beginnings are not remembered
        self.uses[:at] += np.bincount(rows[rows < at], minlength=at)
        return ids, np.add.reduceat(lengths, ends - counts) if len(counts) else np.zeros(0, np.int64)


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def _encoder(tokenizer_path: str, end_id: int) -> PieceEncoder:
    """One encoder a Python worker: its next tasks find the tokenizer loaded and the pieces known."""
    if (tokenizer_path, end_id) not in _encoders:
        _encoders[tokenizer_path, end_id] = PieceEncoder(tokenizer_path, end_id)
    return _encoders[tokenizer_path, end_id]


def _slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of about ``most`` characters."""
    start, held, size = 0, [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size > most:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


def token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``BLOCK_SCHEMA``, in ascending order of doc_id over shards, blocks and the documents of a block."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer_path, end_id)
        ids, lengths, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat, sizes = np.concatenate(ids), np.concatenate(lengths)
            data = encode_block(flat, sizes, encoder.vocabulary)
            values = [[shard], [block], [len(flat)], [names], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "block", "n_tokens", "doc_ids", "data"])

        for batch in batches:
            doc_ids = batch.column(0)
            for first, texts in _slices(batch.column(1)):
                made, sizes = encoder.encode(texts)
                ids.append(made)
                lengths.append(sizes)
                names += doc_ids.slice(first, len(texts)).to_pylist()
                held += len(made)
                if held >= block_tokens:
                    yield flush()
                    block += 1
                    ids, lengths, names, held = [], [], [], 0
        if names:
            yield flush()

    dealt = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie"))
    ordered = dealt.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "tie"
    )
    return ordered.select("doc_id", "text").mapInArrow(gives_back(encode), BLOCK_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """The token files of ``docs`` under ``path``."""
    token_blocks(docs, tokenizer_path, end_id).write.parquet(path)


def read_tokens(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = decode_block(row["data"])
                raw = ids.astype("<u4")
                ends = np.cumsum(lengths)
                parts = [raw[a:b] for a, b in zip(ends - lengths, ends, strict=True)]
                n = len(parts)
                columns = [
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array([row["block"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    documents = blocks.select("shard", "block", "doc_ids", "data").mapInArrow(gives_back(decode), schema + ", ids array<int>" * with_ids)
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.select("shard", "block", "n_tokens")
    few = counts.count() <= BROADCAST_BLOCKS
    shards = counts.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    shards = shards.select("shard", F.coalesce(F.sum("tokens").over(earlier("shard")), F.lit(0)).alias("base"))
    offset = F.coalesce(F.sum("n_tokens").over(earlier("shard", "block")), F.lit(0))
    starts = counts.withColumn("offset", offset).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("offset")).alias("base"))
    joined = documents.join(F.broadcast(starts) if few else starts, ["shard", "block"])
    return joined.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(stored(token_blocks(docs, tokenizer_path), "tokens"), with_ids=False)
