"""Adaptive context-mixing range coder for token ids, in blocks that are reset, checksummed and read on their own.

A block's ids lie in lanes that move in step, so that numpy codes one id of every lane at once. All lanes share one model
which knows only ids of earlier steps, so a reader can follow it: order 2 and order 1 each name the id they last saw in
their context and how sure they are; both certainties together choose an adaptive distribution over {order 2 is right,
order 1 is right, neither}, and in the last case order 0, adaptive counts of the ids that neither foresaw, codes the id.
Each lane has a 64-bit low and range; 32 bits leave at once, and a range that straddles is cut at the border, so that
nothing carries. Integers only, so every machine reads what another wrote.

Block: magic, lanes, tokens, documents, stream words, vocabulary, crc32 of the rest | document lengths | two words a
lane | stream of words in the order in which a reader's lanes ask for them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LLTK"
HEADER = struct.Struct("<4s6I")
MAX_LANES = 8192
STEPS = 128
_U = np.uint64
_32, _MASK32, _FULL = _U(32), _U(0xFFFFFFFF), _U(2**64 - 1)
_FLAG_BITS = _U(12)
_TABLE = 1 << 18
_REBUILD = 16
_MOST = 1 << 19


class _Model:
    """What both sides know: predictions of order 2 and 1 with certainties, and counts."""

    def __init__(self, vocabulary: int, lanes: int):
        self.order2, self.order1 = np.zeros(_TABLE, np.int32), np.zeros(vocabulary, np.int32)  # id * 4 + certainty
        self.flags = np.tile(np.array([3, 2, 3], np.int64), (32, 1))
        self.count = np.ones(vocabulary, np.int64)
        self.recent: list[np.ndarray] = []
        self.before1 = self.before2 = np.zeros(lanes, np.int64)
        self.steps = 0
        self._flags_up()
        self._order0_up()

    def _flags_up(self) -> None:
        total = self.flags.sum(1, keepdims=True)
        share = self.flags * (4096 - 3) // total + 1
        share[:, 2] += 4096 - share.sum(1)
        self.flag_cum = np.zeros((32, 4), np.int64)
        np.cumsum(share, 1, out=self.flag_cum[:, 1:])
        self.flag_cum_u = self.flag_cum.astype(_U)

    def _order0_up(self) -> None:
        if self.count.sum() > _MOST:
            self.count = (self.count + 1) >> 1
        self.cum = np.zeros(len(self.count) + 1, np.int64)
        np.cumsum(self.count, out=self.cum[1:])
        self.cum_u = self.cum.astype(_U)
        self.total = _U(int(self.cum[-1]))
        self.owner = None

    def owners(self, values: np.ndarray) -> np.ndarray:
        """The ids of order 0 that own these values, all below the total: a table of all values, made once for each set of counts."""
        if self.owner is None:
            self.owner = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        return self.owner[values]

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.slot = (self.before2 * 0x9E3779B1 + self.before1 * 0x85EBCA6B >> 7) & (_TABLE - 1)
        self.p2, self.p1 = self.order2[self.slot], self.order1[self.before1]
        self.c2, self.c1 = self.p2 >> 2, self.p1 >> 2
        self.context = (self.p2 & 3) * 4 + (self.p1 & 3) + 16 * (self.c1 == self.c2)
        return self.c2, self.c1, self.context

    def learn(self, ids: np.ndarray, which: np.ndarray, missed: np.ndarray) -> None:
        fresh = (ids * 4).astype(np.int32)
        for known, at, packed, named in ((self.order2, self.slot, self.p2, self.c2), (self.order1, self.before1, self.p1, self.c1)):
            sure = packed & 3
            known[at] = np.where(named == ids, packed + (sure < 3), np.where(sure > 0, packed - 1, fresh))
        self.flags += np.bincount(self.context * 3 + which, minlength=96).reshape(32, 3) * 2
        self.recent.append(missed)
        self.steps += 1
        if self.steps % 2 == 0:
            if self.flags.max() > 1 << 16:
                self.flags = (self.flags + 1) >> 1
            self._flags_up()
        if self.steps % _REBUILD == 0 or self.steps < _REBUILD:
            self.count += 24 * np.bincount(np.concatenate(self.recent), minlength=len(self.count))
            self.recent = []
            self._order0_up()
        self.before2, self.before1 = self.before1, ids


def _lanes_for(n: int) -> int:
    return max(1, min(MAX_LANES, 1 << max(0, (n // STEPS).bit_length() - 1)))


def _ask(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes whose range is short, their ranges cut at a 32-bit border if they straddle one."""
    short = np.flatnonzero(width <= _MASK32)
    if len(short):
        a, w = low[short], width[short]
        straddles = ((a ^ (a + w - _U(1))) >> _32) != 0
        width[short] = np.where(straddles, (~a + _U(1)) & _MASK32, w)
    return short


def encode_block(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> bytes:
    """ids of whole documents one after another, lengths: how many each has."""
    n, lanes = len(ids), _lanes_for(len(ids))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocabulary, lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, _FULL)
    words, owners = [], []
    for x in grid:
        c2, c1, context = model.predict()
        which = np.where(x == c2, 0, np.where(x == c1, 1, 2))
        start = model.flag_cum_u[context, which]
        width >>= _FLAG_BITS
        low += width * start
        width *= model.flag_cum_u[context, which + 1] - start
        missed = np.flatnonzero(which == 2)
        y = x[missed]
        part = width[missed] // model.total
        low[missed] += part * model.cum_u[y]
        width[missed] = part * (model.cum_u[y + 1] - model.cum_u[y])
        short = _ask(low, width)
        if len(short):
            words.append((low[short] >> _32).astype(np.uint32))
            owners.append(short)
            low[short] <<= _32
            width[short] <<= _32
        model.learn(x, which, y)
    everyone = np.arange(lanes)
    words += [(low >> _32).astype(np.uint32), (low & _MASK32).astype(np.uint32)]
    owners += [everyone, everyone]
    word, owner = np.concatenate(words), np.concatenate(owners)
    by_lane = np.argsort(owner, kind="stable")
    sorted_words = word[by_lane]
    first = np.searchsorted(owner[by_lane], everyone)
    place = np.empty(len(word), np.int64)
    place[by_lane] = np.arange(len(word))
    stream = sorted_words[place[: len(word) - 2 * lanes] + 2]  # a reader is two words ahead
    heads = np.stack([sorted_words[first], sorted_words[first + 1]])
    body = lengths.astype("<u4").tobytes() + heads.astype("<u4").tobytes() + stream.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, lanes, n, len(lengths), len(stream), vocabulary, zlib.crc32(body)) + body


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of ``encode_block``; raises ValueError if the block is damaged."""
    if len(block) < HEADER.size:
        raise ValueError("block is cut short")
    magic, lanes, n, n_docs, n_words, vocabulary, crc = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or len(body) != 4 * (n_docs + 2 * lanes + n_words) or zlib.crc32(body) != crc:
        raise ValueError("block is damaged")
    flat = np.frombuffer(body, "<u4")
    lengths, heads = flat[:n_docs].astype(np.int64), flat[n_docs : n_docs + 2 * lanes].astype(_U).reshape(2, lanes)
    stream, at = flat[n_docs + 2 * lanes :].astype(_U), 0
    steps = -(-n // lanes)
    out = np.empty((steps, lanes), np.int64)
    model = _Model(vocabulary, lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, _FULL)
    code = (heads[0] << _32) | heads[1]
    for t in range(steps):
        c2, c1, context = model.predict()
        width >>= _FLAG_BITS
        edges, ahead = model.flag_cum_u[context], code - low
        which = (ahead >= width * edges[:, 1]).astype(np.int64) + (ahead >= width * edges[:, 2])
        start = model.flag_cum_u[context, which]
        low += width * start
        width *= model.flag_cum_u[context, which + 1] - start
        x = np.where(which == 0, c2, c1).astype(np.int64)
        missed = np.flatnonzero(which == 2)
        part = width[missed] // model.total
        value = np.minimum((code[missed] - low[missed]) // part, model.total - _U(1))
        y = model.owners(value.view(np.int64)).astype(np.int64)
        low[missed] += part * model.cum_u[y]
        width[missed] = part * (model.cum_u[y + 1] - model.cum_u[y])
        x[missed] = y
        short = _ask(low, width)
        if len(short):
            low[short] <<= _32
            width[short] <<= _32
            code[short] = (code[short] << _32) | stream[at : at + len(short)]
            at += len(short)
        model.learn(x, which, y)
        out[t] = x
    return out.T.reshape(-1)[:n], lengths
