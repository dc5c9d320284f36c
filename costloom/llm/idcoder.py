"""Adaptive context-mixing range coder for token ids, over many blocks side by side.

Each block is coded on its own from a fresh model. Within a block an id is first a symbol: its number
in the order of first occurrence. Three predictions stand for the next symbol:

* order 2: the symbol that followed the last two symbols before, with a confidence;
* order 1: the symbol that followed the last symbol before, with a confidence;
* order 0: the symbols that order 0 has given before, and all symbols seen so far; else a new id.

Their weights are learnt within the block, in one set for each pair of confidences; where orders 1 and 2
agree their weights add up. The mix drives a carry-less range coder with 64-bit state and 16-bit output
units. The blocks are independent, so a step codes one id of every block at once with array operations,
and the decoder repeats the same steps.
"""

from __future__ import annotations

import numpy as np

#: Units leave when a range falls below LEAST; one that straddles a multiple of 2^TOP then is cut off there.
TOP, LEAST = np.uint64(48), np.uint64(1 << 40)
UNIT = np.uint64(16)
ONE = np.uint64(1)
#: What an outcome adds to its weight.
GAIN = 2
#: Outcomes: order 2, order 1, order 0 among its repeated symbols, order 0 among all symbols, a new id.
SECOND, FIRST, AGAIN, SEEN, NEW = range(5)


def first_weights() -> np.ndarray:
    """Weights of the outcomes at the start of a block, for each pair of confidences (order 2, order 1); 0 means no prediction."""
    out = np.zeros((16, 8), np.int64)
    for a in range(4):
        for b in range(4):
            out[4 * a + b, :5] = 3 * a * a, b * b, 2, 2, 2
    return out


class Model:
    """The models of ``lanes`` blocks of at most ``length`` ids below ``size``."""

    def __init__(self, lanes: int, length: int, size: int):
        lane = np.arange(lanes)
        self.size, self.slots = size, 1 << max(4, (length - 1).bit_length())
        self.room = length + 1
        # orders 1 and 2 stand in one table, so that a step works on both at once
        self.lane, self.at1, self.at2, self.at_w = lane, lane * self.room, lanes * self.room + lane * self.slots, lane * 16
        self.orders = np.zeros(lanes * (self.room + self.slots), np.uint16 if length < 1 << 14 else np.uint32)
        self.weights = np.tile(first_weights(), (lanes, 1)).astype(np.int32)
        self.repeated = np.zeros(lanes * self.room, self.orders.dtype)
        self.place = np.zeros(lanes * self.room, self.orders.dtype)
        self.n_repeated = np.zeros(lanes, np.int64)
        self.n_seen = np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def keep(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        for name in ("lane", "at1", "at2", "at_w", "n_repeated", "n_seen", "last", "before"):
            setattr(self, name, getattr(self, name)[:lanes])

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the outcomes (6 x lanes), and how many alternatives each outcome leaves (5 x lanes)."""
        h = ((self.last * 2654435761 + self.before * 2246822519) >> 15) & (self.slots - 1)
        n = len(self.lane)
        self.places = np.concatenate([self.at1 + self.last, self.at2 + h])
        self.held = self.orders.take(self.places).astype(np.int64)
        self.said, self.sure = self.held >> 2, self.held & 3
        self.s1, self.s2 = self.said[:n], self.said[n:]
        self.row = self.at_w + (self.sure[n:] << 2 | self.sure[:n])
        w = self.weights.take(self.row, axis=0)
        bounds = np.zeros((6, n), np.int64)
        np.add(w[:, 0], w[:, 1] * (self.s1 == self.s2), out=bounds[1])
        np.add(w[:, 0], w[:, 1], out=bounds[2])
        for k in (2, 3, 4):
            np.add(bounds[k], w[:, k], out=bounds[k + 1])
        left = np.ones((5, n), np.int64)
        left[AGAIN], left[SEEN], left[NEW] = self.n_repeated, self.n_seen, self.size
        return bounds, left

    def learn(self, symbol: np.ndarray, outcome: np.ndarray) -> None:
        """Adapt to the symbols that came."""
        both = np.concatenate([symbol, symbol])
        self.orders[self.places] = np.where(self.said == both, self.held + (self.sure < 3), np.where(self.sure > 1, self.held - 1, both << 2 | 1))
        self.weights.reshape(-1)[(self.row << 3) + outcome] += GAIN
        met = np.flatnonzero(outcome == SEEN)
        if len(met):
            n = self.n_repeated[met]
            self.repeated[self.at1[met] + n] = symbol[met]
            self.n_repeated[met] = n + 1
            self.place[self.at1[met] + symbol[met]] = n + 1
        self.n_seen += outcome == NEW
        self.before, self.last = self.last, symbol


def symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ids: every id's number by first occurrence, from 1; and where ids occur first."""
    lanes, n = ids.shape
    out, first = np.empty((lanes, n), np.int32), np.zeros((lanes, n), bool)
    narrow = ids.astype(np.uint16) if ids.size and int(ids.max()) < 1 << 16 else ids  # sorted by radix
    for lo in range(0, lanes, 128):
        part = narrow[lo : lo + 128]
        order = np.argsort(part, axis=1, kind="stable")
        row = np.arange(len(part))[:, None]
        ordered = part[row, order]
        head = np.ones(part.shape, bool)
        head[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        own = first[lo : lo + 128]
        own[row, order] = head
        number = np.cumsum(own, axis=1, dtype=np.int32)
        # the number of each group's first occurrence, spread over the group
        spread = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0), axis=1)
        heads = np.take_along_axis(order, spread, axis=1)
        out[lo : lo + 128][row, order] = np.take_along_axis(number, heads, axis=1)
    return out, first


def lanes_of(n: int, length: int) -> tuple[int, int]:
    """How many blocks ``n`` ids fill, and how many ids the last one has."""
    lanes = max(1, -(-n // length))
    return lanes, n - (lanes - 1) * length


def renewed(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Ranges below LEAST after a unit has left them."""
    apart = ((low ^ (low + span)) >> TOP) != 0
    return np.where(apart, (-low.view(np.int64)).view(np.uint64) & (LEAST - ONE), span) << UNIT


def encode(ids: np.ndarray, length: int, size: int) -> list[bytes]:
    """The coded blocks of ``length`` ids each (the last may be shorter)."""
    if not len(ids):
        return []
    if int(ids.min()) < 0 or int(ids.max()) >= size:
        raise ValueError("an id outside the vocabulary")
    lanes, tail = lanes_of(len(ids), length)
    padded = np.zeros(lanes * length, np.int32)
    padded[: len(ids)] = ids
    padded = padded.reshape(lanes, length)
    symbol, first = symbols(padded)
    symbol, first, padded = np.ascontiguousarray(symbol.T), np.ascontiguousarray(first.T), np.ascontiguousarray(padded.T)
    m = Model(lanes, length, size)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    room = 2 * length + 400
    units, at = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64)
    out: list[bytes] = []
    n = lanes
    for t in range(length):
        if t == tail:
            out.append(flushed(low, units, at, n - 1))
            n -= 1
            if not n:
                break
            m.keep(n)
            low, span, at = low[:n], span[:n], at[:n]
        if not t % 64 and int(at.max()) + 330 > units.shape[1]:
            units = np.concatenate([units, np.zeros_like(units)], axis=1)
        bounds, left = m.predict()
        s = symbol[t, :n].astype(np.int64)
        place = m.place.take(m.at1 + s).astype(np.int64)
        outcome = np.where(s == m.s2, SECOND, np.where(s == m.s1, FIRST, np.where(first[t, :n], NEW, np.where(place > 0, AGAIN, SEEN))))
        which = np.zeros((5, n), np.int64)
        which[AGAIN], which[SEEN], which[NEW] = place - 1, s - 1, padded[t, :n]
        index = outcome * n + m.lane
        flat = bounds.reshape(-1)
        lo, hi = flat.take(index), flat.take(index + n)
        r = span // bounds[5].view(np.uint64)
        low = low + r * lo.view(np.uint64)
        span = r * (hi - lo).view(np.uint64)
        span = span // left.reshape(-1).take(index).view(np.uint64)
        low = low + span * which.reshape(-1).take(index).view(np.uint64)
        m.learn(s, outcome)
        due = np.flatnonzero(span < LEAST)
        while len(due):
            own, g, place = low[due], span[due], at[due]
            g = renewed(own, g)
            units[due, place] = own >> TOP
            low[due], span[due], at[due] = own << UNIT, g, place + 1
            due = due[g < LEAST]
    rest = [flushed(low, units, at, k) for k in range(n)]
    return rest + out


def flushed(low: np.ndarray, units: np.ndarray, at: np.ndarray, k: int) -> bytes:
    """A lane's units and its last state."""
    return units[k, : at[k]].astype("<u2").tobytes() + np.array([int(low[k]) >> s & 0xFFFF for s in (48, 32, 16, 0)], "<u2").tobytes()


def decode(blocks: list[bytes], n_ids: int, length: int, size: int) -> np.ndarray:
    """The ids of :func:`encode`'s blocks."""
    if not n_ids:
        return np.zeros(0, np.int32)
    lanes, tail = lanes_of(n_ids, length)
    if len(blocks) != lanes:
        raise ValueError("a block is missing")
    m = Model(lanes, length, size)
    begin = np.cumsum([0, *(len(b) // 2 for b in blocks)])
    units = np.frombuffer(b"".join([*blocks, bytes(8)]), "<u2").astype(np.uint64)
    at = begin[:-1].copy()
    code = np.zeros(lanes, np.uint64)
    for k in range(4):
        code = code << UNIT | units[at + k]
    at += 4
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    names = np.zeros(lanes * m.room, np.int32)
    symbol = np.zeros((length, lanes), np.int32)
    n, end = lanes, len(units) - 1
    for t in range(length):
        if t == tail:
            n -= 1
            if not n:
                break
            m.keep(n)
            low, span, at, code = low[:n], span[:n], at[:n], code[:n]
        bounds, left = m.predict()
        r = span // bounds[5].view(np.uint64)
        v = ((code - low) // r).view(np.int64)
        outcome = (v >= bounds[1]).astype(np.int64)
        for k in (2, 3, 4):
            outcome += v >= bounds[k]
        index = outcome * n + m.lane
        flat = bounds.reshape(-1)
        lo, hi = flat.take(index), flat.take(index + n)
        low = low + r * lo.view(np.uint64)
        span = r * (hi - lo).view(np.uint64)
        span = span // left.reshape(-1).take(index).view(np.uint64)
        v = (code - low) // span
        low = low + span * v
        v = v.view(np.int64)
        which = np.empty((5, n), np.int64)
        which[SECOND], which[FIRST], which[SEEN], which[NEW] = m.s2, m.s1, v + 1, m.n_seen + 1
        which[AGAIN] = m.repeated.take(m.at1 + np.minimum(v, m.room - 1))
        s = which.reshape(-1).take(index)
        symbol[t, :n] = s
        fresh = np.flatnonzero(outcome == NEW)
        if len(fresh):
            names[m.at1[fresh] + s[fresh]] = v[fresh]
        m.learn(s, outcome)
        due = np.flatnonzero(span < LEAST)
        while len(due):
            own, g, place = low[due], span[due], at[due]
            g = renewed(own, g)
            code[due] = code[due] << UNIT | units[np.minimum(place, end)]
            low[due], span[due], at[due] = own << UNIT, g, place + 1
            due = due[g < LEAST]
    ids = names[symbol.T + (np.arange(lanes) * m.room)[:, None]]
    return ids.reshape(-1)[:n_ids]
