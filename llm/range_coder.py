"""Adaptive context-mixing range coder for token ids, in independent blocks.

A block holds up to BLOCK ids and is coded on its own: every table starts
empty, so any block can be decoded, lost or checked alone.  For each id the
order-2 context (a hash of the two ids before) and the order-1 context (the id
before) each predict one id with a confidence; order 0 is the adaptive
frequency of the block's ids.  How far the two predictions are trusted is
learned for every combination of their confidences and whether they agree, and
the mixed distribution drives one arithmetic coding step per id: predicted by
order 2, predicted by order 1, or the id itself by its frequency.

Blocks are coded side by side, one lane each, so every step is a handful of
vector operations.  Layout of a coded block, little-endian unsigned 32-bit:
number of ids, crc32 of the ids, number of distinct ids, words of the distinct
ids' gaps (bytes, 7 bits each, high bit: more follows, padded), those words,
and the range coder's words.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block; ids after which the order-0 frequencies are summed anew.
BLOCK, RENEW = 4096, 256
_SLOTS = 4096                       # order-2 contexts of a block
_BUCKETS = 512                      # parts of the order-0 total by which a symbol is looked up
_ONE = 4096                         # a probability of 1 in the mixing step
_GAIN, _LEAST = 4000, 48
_RATE = 5
_COUNT = 32                         # weight of one occurrence in the order-0 frequency
_WORD = np.uint64(1 << 32)
_LOW32 = np.uint64((1 << 32) - 1)


def _gaps(ids: np.ndarray) -> bytes:
    """Sorted distinct ids as 7-bit groups of their gaps, padded to words."""
    gap = np.diff(ids, prepend=0).astype(np.uint64)
    parts = np.stack([(gap >> np.uint64(7 * k)) & np.uint64(127) for k in range(5)], axis=1).astype(np.uint8)
    used = np.maximum(1, np.stack([gap >= (1 << 7 * k) for k in range(1, 5)], axis=1).sum(1) + 1)
    keep = np.arange(5) < used[:, None]
    parts[np.arange(5) < used[:, None] - 1] |= 128
    out = parts[keep].tobytes()
    return out + b"\0" * (-len(out) % 4)


def _ids_of(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)[:n]
    group = np.searchsorted(last, np.arange(last[-1] + 1 if n else 0))
    start = np.concatenate([[0], last[:-1] + 1])[group] if n else group
    part = (raw[: len(group)] & 127).astype(np.uint64) << (7 * (np.arange(len(group)) - start)).astype(np.uint64)
    gap = np.zeros(n, np.uint64)
    np.add.at(gap, group, part)
    return np.cumsum(gap).astype(np.uint32)


class _Lanes:
    """Models of the blocks that are coded side by side."""

    def __init__(self, lanes: int, symbols: np.ndarray, search: bool = False):
        self.search = search
        self.k = int(symbols.max())
        # An entry is a symbol, which is below BLOCK, and two bits of confidence.
        self.two = np.zeros(lanes * _SLOTS, np.int16)
        self.one = np.zeros(lanes * (self.k + 1), np.int16)
        self.trust2 = np.full(lanes * 32, _ONE // 2, np.int32)
        self.trust1 = np.full(lanes * 32, _ONE // 4, np.int32)
        lane = np.arange(lanes)
        self.at2, self.at1, self.at_trust, self.at0 = lane * _SLOTS, lane * (self.k + 1), lane * 32, lane * (self.k + 1)
        self.count = (np.arange(self.k) < symbols[:, None]).astype(np.int32)
        self.count_flat = self.count.reshape(-1)
        self.at_count = lane * self.k
        self.sums = np.zeros((lanes, self.k + 1), np.int32)
        self.sums_flat = self.sums.reshape(-1)
        self.p1 = np.zeros(lanes, np.int64)           # contexts are symbols from 1; 0 is the start
        self.p2 = np.zeros(lanes, np.int64)
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)
        self.total = np.ones(lanes, np.uint64)

    def renew(self, a: int) -> None:
        """Frequencies of order 0 as they are now, for the first ``a`` lanes."""
        np.cumsum(self.count[:a], axis=1, out=self.sums[:a, 1:])
        self.total[:a] = self.sums[:a, -1]
        if self.search:
            # Of each lane, how many symbols begin before each of _BUCKETS equal parts of its total.
            self.shift = np.maximum(np.ceil(np.log2(self.total[:a].astype(np.float64))).astype(np.int64) - _BUCKETS.bit_length() + 1, 0)
            self.parts = np.empty((a, _BUCKETS + 2), np.int32)
            for b in range(0, a, 64):                 # few lanes at a time, for little memory
                c = min(b + 64, a)
                part = (self.sums[b:c, :-1] >> self.shift[b:c, None]) + (np.arange(c - b) * (_BUCKETS + 2) + 1)[:, None]
                self.parts[b:c] = np.cumsum(np.bincount(part.reshape(-1), minlength=(c - b) * (_BUCKETS + 2)).reshape(c - b, -1), axis=1)
            self.parts = self.parts.reshape(-1)

    def find(self, e: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Place in the sums of the last symbol of lanes ``e`` that begins at ``want`` or before."""
        at = e * (_BUCKETS + 2) + (want >> self.shift.take(e))
        base = self.at0.take(e)
        low, high = np.maximum(self.parts.take(at) - 1, 0) + base, self.parts.take(at + 1) - 1 + base
        for _ in range(int((high - low).max()).bit_length()):
            middle = (low + high + 1) >> 1
            fits = self.sums_flat.take(middle) <= want
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def predict(self, a: int) -> None:
        p1, p2 = self.p1[:a], self.p2[:a]
        self.i2 = self.at2[:a] + ((p2 * 2654435 + p1 * 40503) >> 3 & (_SLOTS - 1))
        self.i1 = self.at1[:a] + p1
        self.e2, self.e1 = self.two.take(self.i2), self.one.take(self.i1)
        self.c2, self.c1 = self.e2 & 3, self.e1 & 3
        self.q2, self.q1 = self.e2 >> 2, self.e1 >> 2
        self.sure2 = self.c2 > 0
        self.sure1 = (self.c1 > 0) & ~(self.sure2 & (self.q2 == self.q1))
        self.it = self.at_trust[:a] + (self.c2 * 8 + self.c1 * 2 + self.sure1)
        self.w2, self.w1 = self.trust2.take(self.it), self.trust1.take(self.it)
        self.f2 = self.w2 * self.sure2
        self.f1 = (((_ONE - self.f2) * self.w1) >> 12) * self.sure1

    def learn(self, a: int, s: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        kept = (s << 2) + 1
        # A hit gains confidence, a miss loses some, and the last of it gives way to the new id.
        self.two[self.i2] = np.where(hit2, self.e2 + (self.c2 < 3), np.where(self.c2 > 1, self.e2 - 1, kept))
        same1 = (self.c1 > 0) & (self.q1 == s)
        self.one[self.i1] = np.where(same1, self.e1 + (self.c1 < 3), np.where(self.c1 > 1, self.e1 - 1, kept))
        self.trust2[self.it] = self.w2 + ((hit2 * _GAIN + _LEAST - self.w2) >> _RATE)
        self.trust1[self.it] = self.w1 + (((hit1 * _GAIN + _LEAST - self.w1) >> _RATE) * ~hit2)
        self.count_flat[self.at_count[:a] + s] += _COUNT
        self.p2[:a] = self.p1[:a]
        self.p1[:a] = s + 1


def _order(lengths: np.ndarray) -> np.ndarray:
    """Longest first, so that the lanes still at work are always the first ones."""
    return np.argsort(-lengths, kind="stable")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (unsigned, below 2**32, at most BLOCK of them) coded."""
    if not blocks:
        return []
    lengths = np.array([len(b) for b in blocks])
    order = _order(lengths)
    steps = int(lengths.max())
    symbol = np.zeros((len(blocks), max(steps, 1)), np.int16)
    alphabets = []
    rank = np.zeros(1 << 16, np.int32)
    mark = np.zeros(1 << 16, bool)
    for lane, k in enumerate(order):
        ids = blocks[k]
        if len(ids) and ids.max() < 1 << 16:          # a table instead of a sort
            mark[ids] = True
            own = np.flatnonzero(mark)
            rank[own] = np.arange(len(own))
            symbol[lane, : len(ids)] = rank[ids]
            mark[own] = False
        else:
            own, inverse = np.unique(ids, return_inverse=True)
            symbol[lane, : len(ids)] = inverse
        alphabets.append(own.astype(np.uint32))
    symbol = np.ascontiguousarray(symbol.T)
    m = _Lanes(len(blocks), np.array([max(1, len(x)) for x in alphabets]))
    out = np.zeros((len(blocks), steps + 3), np.uint32)
    used = np.zeros(len(blocks), np.int64)
    active = np.searchsorted(-lengths[order], -np.arange(steps), side="left")     # lanes longer than t
    for t in range(steps):
        a = int(active[t])
        if t % RENEW == 0:
            m.renew(a)
        s = symbol[t, :a]
        m.predict(a)
        hit2 = m.sure2 & (m.q2 == s)
        hit1 = m.sure1 & (m.q1 == s)
        f12 = m.f2 + m.f1
        miss = ~(hit2 | hit1)
        at = np.where(hit2, 0, np.where(hit1, m.f2, f12)).astype(np.uint64)
        width = np.where(hit2, m.f2, np.where(hit1, m.f1, _ONE - f12)).astype(np.uint64)
        low, rng = m.low[:a], m.range[:a]
        step = rng >> np.uint64(12)
        low += step * at
        np.multiply(step, width, out=rng)
        e = np.flatnonzero(miss)
        if len(e):
            r0 = rng[e] // m.total[e]
            i = m.at0[e] + s[e]
            start = m.sums_flat[i]
            low[e] += r0 * start.astype(np.uint64)
            rng[e] = r0 * (m.sums_flat[i + 1] - start).astype(np.uint64)
        e = np.flatnonzero(rng < _WORD)
        if len(e):
            x, r = low[e], rng[e]
            r = np.where((x ^ (x + r)) < _WORD, r, (np.uint64(0) - x) & _LOW32)
            out[e, used[e]] = x >> np.uint64(32)
            used[e] += 1
            low[e] = x << np.uint64(32)
            rng[e] = r << np.uint64(32)
        m.learn(a, s, hit2, hit1)
    result: list[bytes] = [b""] * len(blocks)
    for lane, k in enumerate(order):
        ids = blocks[k].astype("<u4")
        gaps = _gaps(alphabets[lane])
        tail = np.array([m.low[lane] >> np.uint64(32), m.low[lane] & _LOW32], np.uint32)
        head = np.array([len(ids), zlib.crc32(ids.tobytes()), len(alphabets[lane]), len(gaps) // 4], "<u4")
        result[k] = head.tobytes() + gaps + out[lane, : used[lane]].astype("<u4").tobytes() + tail.astype("<u4").tobytes()
    return result


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded block; ValueError if a checksum does not agree."""
    if not blocks:
        return []
    heads = np.array([np.frombuffer(b[:16], "<u4") for b in blocks], np.int64)
    lengths = heads[:, 0]
    order = _order(lengths)
    steps = int(lengths.max())
    alphabets, words = [], []
    for k in order:
        gaps = 16 + 4 * int(heads[k, 3])
        alphabets.append(_ids_of(blocks[k][16:gaps], int(heads[k, 2])))
        words.append(np.frombuffer(blocks[k][gaps:], "<u4"))
    size = np.array([len(w) for w in words])
    stream = np.concatenate([*words, np.zeros(2, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    m = _Lanes(len(blocks), np.array([max(1, len(x)) for x in alphabets]), search=True)
    code = (stream[at] << np.uint64(32)) | stream[at + 1]
    at = at + 2
    symbol = np.zeros((max(steps, 1), len(blocks)), np.int16)
    active = np.searchsorted(-lengths[order], -np.arange(steps), side="left")
    end = len(stream) - 1
    for t in range(steps):
        a = int(active[t])
        if t % RENEW == 0:
            m.renew(a)
        m.predict(a)
        low, rng = m.low[:a], m.range[:a]
        step = rng >> np.uint64(12)
        off = code[:a] - low
        f2 = step * m.f2.astype(np.uint64)
        f12 = m.f2 + m.f1
        edge = step * f12.astype(np.uint64)
        hit2 = off < f2
        hit1 = (off < edge) & ~hit2
        s = np.where(hit2, m.q2, m.q1)
        low += np.where(hit2, np.uint64(0), np.where(hit1, f2, edge))
        np.multiply(step, np.where(hit2, m.f2, np.where(hit1, m.f1, _ONE - f12)).astype(np.uint64), out=rng)
        e = np.flatnonzero(~(hit2 | hit1))
        if len(e):
            total = m.total[e]
            r0 = rng[e] // total
            want = np.minimum((off[e] - edge[e]) // r0, total - np.uint64(1)).astype(np.int64)
            # Symbols of no width end a lane with equal sums; the wanted one is before them.
            found = m.find(e, want)
            s[e] = found - m.at0[e]
            start = m.sums_flat[found]
            low[e] += r0 * start.astype(np.uint64)
            rng[e] = r0 * (m.sums_flat[found + 1] - start).astype(np.uint64)
        e = np.flatnonzero(rng < _WORD)
        if len(e):
            x, r = low[e], rng[e]
            r = np.where((x ^ (x + r)) < _WORD, r, (np.uint64(0) - x) & _LOW32)
            code[e] = (code[e] << np.uint64(32)) | stream[np.minimum(at[e], end)]
            at[e] += 1
            low[e] = x << np.uint64(32)
            rng[e] = r << np.uint64(32)
        m.learn(a, s, hit2, hit1)
        symbol[t, :a] = s
    symbol = np.ascontiguousarray(symbol.T)
    result: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for lane, k in enumerate(order):
        ids = alphabets[lane][symbol[lane, : lengths[k]]] if lengths[k] else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != heads[k, 1]:
            raise ValueError("a block's checksum does not agree with its ids")
        result[k] = ids
    return result
