"""Adaptive context-mixing coder for token ids.

A shard of ids is cut into blocks that are coded independently: each starts from
the same reset state, has its own checksum and can be read alone. All blocks of
a shard run side by side, one array element per block, so a step of the coder is
a few array operations.

Per id: the order-2 context (two ids back) and the order-1 context (one back)
each predict the id that followed last time. Whether a prediction holds is coded
with a probability mixed, in the logistic domain with learned weights, from
adaptive estimates over the confidence of the contexts, the previous id and the
recent outcomes; where the two differ, which of them holds is coded alike. The
ids that nothing predicted are a second stream of the block, coded by order 0: an
adaptive distribution over frequency classes, then the shard's frequencies of
such ids inside the class. So the first stream alone depends on the ids before,
and a step of the second has the blocks with ids left only. Both streams are
coded by an asymmetric numeral system, last id first. All arithmetic is on
integers, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib
from decimal import Decimal
from functools import lru_cache

import numpy as np

BLOCK = 2048
#: Order-0 frequency classes, more only where a class would hold over CLASS_SYMBOLS ids.
CLASSES = 16
CLASS_SYMBOLS = 1 << 15
_TABLE_BITS = 10
#: Shares of a class, of the classes and of a decision add up to these powers of two.
_SHARE_BITS, _CLASS_BITS, _FLAG_BITS = 16, 15, 12
_ONE = 1 << _SHARE_BITS
#: Least confidence of a guess that is asked for.
_ASKED = 2
#: Speed of the estimates (a shift). The classes count _START ids to begin with, are settled anew every _LOOK ids and halve
#: their counts every _HALVE.
_RATE, _START, _LOOK, _HALVE = 4, 128, 32, 256
#: Bound of a mixing weight: three products of a weight and a 12-bit value stay within 31 bits.
_MOST = 1 << 18
_WORD = np.uint64(32)
_EDGE = np.uint64(1 << 32)
#: Table ids up to this one are counted by place.
_DENSE = 1 << 22
_PART = 1 << 20
MAGIC = b"IDMIX02\n"


class DamagedBlock(ValueError):
    """A checksum does not hold."""


@lru_cache(1)
def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """stretch (4096 entries) and squash (4095 entries for -2047..2047), in decimal arithmetic: alike everywhere."""
    stretch = [0] + [int(max(-2047, min(2047, (256 * (Decimal(p) / (4096 - p)).ln()).to_integral_value()))) for p in range(1, 4096)]
    stretch[0] = -2047
    squash = [int((4096 / (1 + (-Decimal(d) / 256).exp())).to_integral_value()) for d in range(-2047, 2048)]
    return np.array(stretch, np.int32), np.clip(np.array(squash, np.int32), 1, 4095)


class _Writer:
    """One stream per lane, filled from its end: what is put last is read first."""

    def __init__(self, lanes: int, most: int):
        self.x = np.full(lanes, _EDGE)
        self.end = (np.arange(lanes) + 1) * (most + 2)
        self.at = self.end.copy()
        self.words = np.zeros(lanes * (most + 2), np.uint32)

    def _settle(self, lanes, x, full):
        """Write the lower words of the states at ``full`` of ``x``, the states of ``lanes`` (None: the leading ones)."""
        if len(full):
            who = full if lanes is None else lanes[full]
            at = self.at[who] - 1
            self.at[who] = at
            self.words[at] = x[full].astype(np.uint32)
            x[full] >>= _WORD

    def flag(self, lanes, p, bit):
        p = p.astype(np.uint64)
        size = np.where(bit, p, np.uint64(1 << _FLAG_BITS) - p)
        x = self.x.take(lanes)
        self._settle(lanes, x, np.flatnonzero((x >> np.uint64(64 - _FLAG_BITS)) >= size))
        whole = x // size
        x += whole * (np.uint64(1 << _FLAG_BITS) - size) + p * ~bit
        self.x[lanes] = x

    def pair(self, first, size1, start1, size2, start2):
        """Two nested shares at once of the leading lanes: of the class ``1`` is read first."""
        x = self.x[:first]
        size1, size2 = size1.astype(np.uint64), size2.astype(np.uint64)
        self._settle(None, x, np.flatnonzero((x >> np.uint64(64 - _CLASS_BITS - _SHARE_BITS)) >= size1 * size2))
        whole = x // size2
        x += whole * (np.uint64(1 << _SHARE_BITS) - size2) + start2.astype(np.uint64)
        whole = x // size1
        x += whole * (np.uint64(1 << _CLASS_BITS) - size1) + start1.astype(np.uint64)

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of each lane, all words behind one another)."""
        self.words[self.at - 1] = self.x.astype(np.uint32)
        self.words[self.at - 2] = (self.x >> _WORD).astype(np.uint32)
        size = self.end - self.at + 2
        ends = np.cumsum(size)
        out = np.empty(ends[-1], np.uint32)
        for start, n, end in zip((self.at - 2).tolist(), size.tolist(), ends.tolist()):
            out[end - n:end] = self.words[start:start + n]
        return size, out


class _Reader:
    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words = np.append(words, np.zeros(2, np.uint32)).astype(np.uint64)
        self.next = starts + 2
        self.x = self.words[starts] << _WORD | self.words[starts + 1]

    def _fill(self, lanes, x):
        low = np.flatnonzero(x < _EDGE)
        if len(low):
            who = low if lanes is None else lanes[low]
            at = self.next[who]
            self.next[who] = at + 1
            x[low] = x[low] << _WORD | self.words.take(at, mode="clip")

    def flag(self, lanes, p):
        x = self.x.take(lanes)
        p = p.astype(np.uint64)
        slot = x & np.uint64((1 << _FLAG_BITS) - 1)
        bit = slot < p
        x = (x >> np.uint64(_FLAG_BITS)) * np.where(bit, p, np.uint64(1 << _FLAG_BITS) - p) + slot - p * ~bit
        self._fill(lanes, x)
        self.x[lanes] = x
        return bit

    def slot(self, first: int, bits: int) -> np.ndarray:
        return self.x[:first] & np.uint64((1 << bits) - 1)

    def take(self, first: int, bits: int, slot, size, start):
        x = self.x[:first]
        x >>= np.uint64(bits)
        x *= size.astype(np.uint64)
        x += slot - start.astype(np.uint64)

    def fill(self, first: int):
        self._fill(None, self.x[:first])


class _Known:
    """Gives the decisions that are known and keeps them with their probabilities, for a writer to put in reverse."""

    def __init__(self):
        self.kept: list[tuple] = []

    def decide(self, lanes, p, bit):
        self.kept.append((lanes, p.astype(np.uint16), bit))
        return bit

    def write(self, writer: _Writer):
        while self.kept:
            writer.flag(*self.kept.pop())


class _Read:
    def __init__(self, reader: _Reader):
        self.reader = reader

    def decide(self, lanes, p, bit):
        return self.reader.flag(lanes, p)


class _Flag:
    """A yes/no decision with a mixed adaptive probability, one state per lane."""

    def __init__(self, lanes: int, contexts: tuple[int, ...]):
        ahead = np.cumsum((0, *contexts))
        self.lanes = lanes
        self.p = np.full(lanes * ahead[-1], 1 << 13, np.uint16)
        self.ahead = ahead[:-1, None] * lanes
        self.row = np.arange(len(contexts))[:, None] * lanes
        self.weight = np.full(len(contexts) * lanes, 26000, np.int32)

    def code(self, coder, lanes, contexts, bit):
        """``contexts``: one row per estimate, of the chosen ``lanes``."""
        stretch, squash = _logistic()
        at = contexts * self.lanes
        at += self.ahead
        at += lanes
        row = self.row + lanes
        weight = self.weight.take(row)
        p = self.p.take(at).astype(np.int32)
        s = stretch.take(p >> 4)
        dot = np.add.reduce(s * weight, axis=0, dtype=np.int32)
        dot >>= 16
        dot += 2047
        mixed = squash.take(dot, mode="clip")
        bit = coder.decide(lanes, mixed, bit)
        one = bit.astype(np.int32)
        p += (one * 65471 + 32 - p) >> _RATE
        self.p[at] = p
        one <<= 12
        one -= mixed
        one *= 6
        s *= one
        s += 0x8000
        s >>= 16
        s += weight
        np.minimum(s, _MOST, out=s)
        np.maximum(s, -_MOST, out=s)
        self.weight[row] = s
        return bit


class _Symbols:
    """The ids that nothing predicted, in the order of the shard's table, in classes of about equal weight."""

    def __init__(self, counts: np.ndarray):
        total = max(int(counts.sum()), 1)
        before = np.cumsum(counts) - counts
        kind = before * CLASSES // total
        place = np.arange(len(counts)) - np.searchsorted(kind, kind)
        _, kind = np.unique(kind * (1 << 32) + place // CLASS_SYMBOLS, return_inverse=True)
        self.kind = kind.astype(np.int64)
        self.classes = n = int(self.kind.max(initial=0)) + 1
        self.first = np.searchsorted(self.kind, np.arange(n + 1))
        self.size = np.zeros(len(counts), np.int64)
        self.start = np.zeros(len(counts), np.int64)
        self.weight = np.add.reduceat(counts, self.first[:-1]) if len(counts) else np.zeros(1, np.int64)
        for a, z, weight in zip(self.first, self.first[1:], self.weight.tolist()):
            share = 1 + counts[a:z] * (_ONE - (z - a)) // max(weight, 1)
            share[0] += _ONE - share.sum()
            self.size[a:z] = share
            self.start[a:z] = np.cumsum(share) - share

    def inverse(self) -> np.ndarray:
        return np.concatenate([np.repeat(np.arange(a, z, dtype=np.int32), self.size[a:z]) for a, z in zip(self.first, self.first[1:])])


class _Classes:
    """Adaptive bounds of the classes, one column per lane, from counts that are looked at every few steps.

    A class always keeps a least share."""

    def __init__(self, symbols: _Symbols, lanes: int):
        n, one = symbols.classes, 1 << _CLASS_BITS
        self.least = max(1, min(16, one // (4 * n)))
        self.rest = one - n * self.least
        self.lanes, self.every, self.steps = lanes, np.arange(lanes), 0
        self.counts = np.repeat(np.maximum(symbols.weight * _START // max(int(symbols.weight.sum()), 1), 1).astype(np.int32)[:, None], lanes, axis=1)
        self.flat_counts = self.counts.reshape(-1)
        self.bounds = np.zeros((n + 1, lanes), np.uint16)
        self.flat = self.bounds.reshape(-1)
        self._settle(lanes)

    def _settle(self, first: int) -> None:
        whole = np.cumsum(self.counts[:, :first], axis=0, dtype=np.int32)
        total = whole[-1].copy()
        whole *= self.rest
        whole //= total
        whole += np.arange(1, len(whole) + 1, dtype=np.int32)[:, None] * self.least
        self.bounds[1:, :first] = whole

    def find(self, slot: np.ndarray) -> np.ndarray:
        """The class of each of the leading lanes."""
        inner = self.bounds[1:-1, :len(slot)]
        return np.add.reduce((inner <= slot.astype(np.uint16)).view(np.uint8), axis=0, dtype=np.uint8 if len(inner) < 256 else np.int64)

    def share(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Size and start of the classes, which count from now on."""
        at = kind * self.lanes
        at += self.every[:len(kind)]
        self.flat_counts[at] += 1
        start = self.flat.take(at)
        at += self.lanes
        size = self.flat.take(at) - start
        self.steps += 1
        if self.steps % _LOOK == 0:
            if self.steps % _HALVE == 0:
                inner = self.counts[:, :len(kind)]
                inner -= inner >> 1
            self._settle(len(kind))
        return size, start


#: A table entry's lower bits, the confidence (0: empty), after a wrong (0-7) or right (8-15) guess.
_TRUST = np.array([max(1, v >> 1) for v in range(8)] + [min(v + 1, 7) for v in range(8)], np.int32)


def _flags(coder, steps: int, lanes: int, ranks: np.ndarray | None, fresh: np.ndarray | None) -> np.ndarray:
    """Code the decisions of all blocks in lockstep, id by id.

    Writing: ``ranks`` (steps x lanes) are known; returns where no guess held. Reading: ``fresh`` (a row per lane) are
    the unpredicted ids in order; returns the ranks.
    """
    out = np.ones((steps, lanes), bool) if fresh is None else np.empty((steps, lanes), np.int32)
    every = np.arange(lanes)
    #: guess and three bits of confidence by (order, slot, lane): lanes mostly share the busy slots
    table = np.full(2 * lanes << _TABLE_BITS, -8, np.int32)
    base = every + np.array([[0], [lanes << _TABLE_BITS]])
    hits = _Flag(lanes, (64, 256, 16))
    slot, where = np.empty((2, lanes), np.uint32), np.empty((2, lanes), np.int64)
    past = np.zeros(lanes, np.int64)
    pair = np.array([[0], [lanes]])
    mixed = before = np.zeros(lanes, np.uint32)
    x = np.zeros(lanes, np.int32)
    if fresh is not None:
        flat, at = fresh.reshape(-1), every * fresh.shape[1]
    for t in range(steps):
        slot[0] = mixed
        np.multiply(before, np.uint32(0x85EBCA77), out=slot[1])
        slot[1] += mixed
        np.right_shift(slot, np.uint32(32 - _TABLE_BITS), out=slot)
        np.multiply(slot, lanes, out=where)
        where += base
        entry = table.take(where)
        trust = entry & 7
        live = np.flatnonzero((trust[0] | trust[1]) >= _ASKED)
        last = x
        if ranks is not None:
            x = ranks[t]
        else:
            x = flat.take(at, mode="clip")
        if len(live):
            both = live + pair
            one, two = trust.take(both)
            guess = entry.take(both)
            guess >>= 3
            guess = np.where(two >= _ASKED, guess[1], guess[0])  # order 2 before order 1
            estimates = np.empty((3, len(live)), np.int64)
            np.left_shift(two, 3, out=estimates[0])
            estimates[0] += one
            np.bitwise_and(last.take(live), 255, out=estimates[1])
            recent = past.take(live, out=estimates[2], mode="clip")
            hit = hits.code(coder, live, estimates, None if ranks is None else guess == x.take(live))
            recent <<= 1
            recent += hit
            recent &= 15
            past[live] = recent
            held = np.flatnonzero(hit)
            lane = live.take(held)
            if ranks is None:
                x[lane] = np.maximum(guess.take(held), 0)
            else:
                out[t, lane] = False
        if ranks is None:
            out[t] = x
            at += 1
            if len(live):
                at[lane] -= 1
        right = (entry >> 3) == x
        trust += right.view(np.int8) << 3
        table[where] = (x << 3) + _TRUST.take(trust)
        before, mixed = mixed, x.view(np.uint32) * np.uint32(0x9E3779B1)
    return out


def _write_fresh(symbols: _Symbols, ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Streams of the unpredicted ids: ``ranks`` holds those of a lane behind those of the lanes before it."""
    lanes = len(counts)
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    live = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")  # lanes with an id at each step
    classes = _Classes(symbols, lanes)
    kept = []
    for t, n in enumerate(live.tolist()):
        x = ranks.take(starts[:n] + t)
        kind = symbols.kind.take(x)
        kept.append((n, x, *classes.share(kind)))
    writer = _Writer(lanes, len(live))
    while kept:
        n, x, size, start = kept.pop()
        writer.pair(n, size, start, symbols.size.take(x), symbols.start.take(x))
    back = np.empty(lanes, np.int64)
    back[order] = np.arange(lanes)
    writer.at, writer.end, writer.x = writer.at[back], writer.end[back], writer.x[back]
    return writer.done()


def _read_fresh(symbols: _Symbols, words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The unpredicted ids, one row per lane."""
    order = np.argsort(-counts, kind="stable")
    live = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
    reader, classes, inverse = _Reader(words, starts[order]), _Classes(symbols, len(counts)), symbols.inverse()
    out = np.zeros((max(len(live), 1), len(counts)), np.int32)
    for t, n in enumerate(live.tolist()):
        slot = reader.slot(n, _CLASS_BITS)
        kind = classes.find(slot).astype(np.int64)
        reader.take(n, _CLASS_BITS, slot, *classes.share(kind))
        slot = reader.slot(n, _SHARE_BITS)
        kind <<= _SHARE_BITS
        kind += slot.view(np.int64)
        x = inverse.take(kind)
        reader.take(n, _SHARE_BITS, slot, symbols.size.take(x), symbols.start.take(x))
        reader.fill(n)
        out[t, :n] = x
    rows = np.empty(out.shape[::-1], np.int32)
    rows[order] = out.T
    return rows


def _counts(values: np.ndarray, n: int) -> np.ndarray:
    return sum((np.bincount(values[a:a + _PART], minlength=n) for a in range(0, len(values), _PART)), np.zeros(n, np.int64))


def _table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids by falling frequency, the rank of each id)."""
    most = int(ids.max(initial=0))
    if most <= _DENSE:
        counts = _counts(ids, most + 1)
        values = np.flatnonzero(counts)
        values = values[np.argsort(-counts[values], kind="stable")]
        rank = np.zeros(most + 1, np.int32)
        rank[values] = np.arange(len(values))
        out = np.empty(len(ids), np.int32)
        for a in range(0, len(ids), _PART):  # a part at a time, as an index takes eight bytes
            rank.take(ids[a:a + _PART], out=out[a:a + _PART], mode="clip")
        return values, out
    values, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values))
    return values[order], rank[inverse]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard: header, id table, block table and the coded blocks.

    The id table has the ids by falling frequency and how often each was not predicted; the block table has, per block, the
    words of both streams, its unpredicted ids and the checksum of its ids.
    """
    ids = np.ascontiguousarray(ids, np.uint32)
    steps = min(block, len(ids))
    lanes = -(-len(ids) // steps) if steps else 0
    values, rank = _table(ids)
    counts, index, body = np.zeros(len(values), np.int64), np.zeros((4, 0), "<u4"), []
    if lanes:
        padded = np.zeros(lanes * steps, np.int32)
        padded[:len(ids)] = rank
        rank = np.ascontiguousarray(padded.reshape(lanes, steps).T)
        del padded
        coder = _Known()
        fresh = _flags(coder, steps, lanes, rank, None)
        writer = _Writer(lanes, steps)
        coder.write(writer)
        flag_words, words = writer.done()
        body.append(words)
        left = rank.T[fresh.T]
        counts = _counts(left, len(values))
        n_fresh = np.count_nonzero(fresh, axis=0)
        del writer, coder, fresh, rank
        fresh_words, words = _write_fresh(_Symbols(counts), left, n_fresh)
        body.append(words)
        sums = [zlib.crc32(ids[i:i + steps].astype("<u4", copy=False)) for i in range(0, len(ids), steps)]
        index = np.array([flag_words, fresh_words, n_fresh, sums], "<u4")
    head = struct.pack("<QIII", len(ids), steps, lanes, len(values))
    table = np.concatenate([values.astype("<u4"), counts.astype("<u4")]).tobytes() + index.tobytes()
    return b"".join([MAGIC, head, struct.pack("<I", zlib.crc32(head + table)), table, *(w.astype("<u4", copy=False).tobytes() for w in body)])


def decode(data: bytes, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of a shard, or of some of its blocks; raises DamagedBlock where a checksum does not hold."""
    at = len(MAGIC)
    size = struct.calcsize("<QIII")
    head = data[at:at + size]
    if data[:at] != MAGIC or len(head) < size:
        raise DamagedBlock("not a shard")
    total, steps, lanes, n = struct.unpack("<QIII", head)
    (check,) = struct.unpack_from("<I", data, at + size)
    at += size + 4
    table = data[at:at + 8 * n + 16 * lanes]
    if zlib.crc32(head + table) != check:
        raise DamagedBlock("header")
    if not lanes:
        return np.zeros(0, np.uint32)
    values, counts = np.frombuffer(table, "<u4", 2 * n).reshape(2, n)
    flag_words, fresh_words, n_fresh, sums = np.frombuffer(table, "<u4", offset=8 * n).reshape(4, lanes).astype(np.int64)
    at += len(table)
    cut = at + 4 * int(flag_words.sum())
    end = cut + 4 * int(fresh_words.sum())
    if len(data) < end:
        raise DamagedBlock("cut short")
    chosen = np.arange(lanes)[blocks]
    if not len(chosen):
        return np.zeros(0, np.uint32)
    fresh = _read_fresh(_Symbols(counts.astype(np.int64)), np.frombuffer(data[cut:end], "<u4"),
                        (np.cumsum(fresh_words) - fresh_words)[chosen], n_fresh[chosen])
    reader = _Reader(np.frombuffer(data[at:cut], "<u4"), (np.cumsum(flag_words) - flag_words)[chosen])
    ranks = _flags(_Read(reader), steps, len(chosen), None, fresh)
    del fresh
    out = values.astype(np.uint32).take(ranks.T, mode="clip")
    parts = []
    for row, i in zip(out, chosen.tolist()):
        ids = row[:min(steps, total - i * steps)]
        if zlib.crc32(ids.astype("<u4", copy=False)) != sums[i]:
            raise DamagedBlock(f"block {i}")
        parts.append(ids)
    return np.concatenate(parts)
