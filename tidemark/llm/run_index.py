"""Run-length index: the Burrows-Wheeler transform of repetitive pieces, kept as runs.

Suffixes are sorted by their first `window` symbols, equal ones by the symbol before, which keeps
the runs long and is all that a search for up to `window` symbols needs. Rank needs only the runs,
one binary search each. Positions are sampled at the ends of runs; the place of an interval's first
row is carried along: a step either follows that row or jumps to the next run of the symbol, whose
first row is sampled. Rows that share `window` symbols keep no order among each other from step to
step, so the first and the earliest place of every repeated context are kept as well. Dropping the
last symbol can widen the interval to an earlier row; the first rows of those branching contexts
are sampled too.
"""

from __future__ import annotations

import numpy as np

from .fm_index import Bits

#: Symbols of a byte each that one sort takes at first, and the bits of a packed key.
PACKED, KEY_BITS = 8, 63


def _dense(key: np.ndarray) -> np.ndarray:
    """The rank of every key among the distinct ones, in four bytes where they do."""
    order = np.argsort(key)
    key = key[order]
    kind = np.int32 if len(key) < 1 << 31 else np.int64
    rank = np.empty(len(key), kind)
    rank[order] = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])), dtype=kind)
    return rank


def _offsets(size: int, width: int) -> list[int]:
    """Where pieces of `width` symbols must start to cover `size` symbols, the last one flush with the end."""
    return [*range(0, size - width, width), size - width]


def ranks_by_packing(text: np.ndarray, window: int) -> dict[int, np.ndarray]:
    """Ranks of every suffix by prefixes up to `window` symbols: each sort packs as many known ranks as a key holds."""
    width = min(PACKED, window - 1)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(width, np.uint64)))
    code = np.zeros(len(text), np.uint64)
    for j in range(width):
        code = (code << np.uint64(8)) | padded[j : j + len(text)]
    ranks = {width: _dense(code)}
    while width < window:
        rank = ranks[width]
        bits = max(1, int(rank.max()).bit_length())
        wider = min(window, width * (KEY_BITS // bits))
        padded, key = np.concatenate((rank, np.zeros(wider, rank.dtype))), np.zeros(len(rank), np.int64)
        for j in _offsets(wider, width):
            key = (key << bits) | padded[j : j + len(rank)]
        width = wider
        ranks[width] = _dense(key)
    return ranks


def _starts(order: np.ndarray, ranks: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Marks the rows, in suffix order, whose first `size` symbols differ from those of the row before."""
    width = max(w for w in ranks if w <= size)
    padded, new = np.concatenate((ranks[width], np.zeros(size, ranks[width].dtype))), np.zeros(len(order), bool)
    for j in _offsets(size, width):
        part = padded[order + j]
        new[1:] |= part[1:] != part[:-1]
    new[0] = True
    return new


class RunIndex:
    """`text` holds symbols from 1 to 255; pieces end in 0, windows of six or more never cross an end."""

    def __init__(self, text: np.ndarray, window: int) -> None:
        ranks = ranks_by_packing(text, window)
        order = np.argsort((ranks[window].astype(np.int64) << 8) | np.roll(text, 1))
        bwt = text[order - 1]
        rows = self.rows = len(text)
        first = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        length = np.diff(np.concatenate((first, [rows])))
        by_symbol = np.argsort(bwt[first], kind="stable")
        self.head, self.first, self.length = bwt[first][by_symbol].astype(np.int64), first[by_symbol], length[by_symbol]
        self.key = self.head * (rows + 1) + self.first
        self.target = np.cumsum(self.length) - self.length  # runs stand by symbol, so this is where a run's first row leads
        self.sample = order[self.first]
        by_window = ranks[window][order]
        inner = np.concatenate(([True], by_window[1:] != by_window[:-1]))
        ranks.pop(window)
        outer = _starts(order, ranks, window - 1)
        self.outer, at = Bits(outer), np.flatnonzero(outer)
        self.outer_first, self.outer_end = at, np.concatenate((at[1:], [rows]))
        self.outer_sample = np.where(np.add.reduceat(inner, at, dtype=np.int64) > 1, order[at], -1)
        at = np.flatnonzero(inner)
        several = np.diff(np.concatenate((at, [rows]))) > 1
        self.repeated = at[several]
        self.first_place = order[self.repeated]
        self.earliest = np.minimum.reduceat(order, at)[several]

    def start(self, streams: int) -> tuple[np.ndarray, ...]:
        return np.zeros(streams, np.int64), np.full(streams, self.rows), np.zeros(streams, np.int64)

    def shorten(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Drops the last of `window` symbols."""
        group = self.outer.rank(low + 1) - 1
        sampled = self.outer_sample[group]
        return self.outer_first[group], self.outer_end[group], np.where(sampled >= 0, sampled, place)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """One backward step; `place` is where the first row of the interval stands in the text."""
        base = symbol * np.int64(self.rows + 1)
        run = np.searchsorted(self.key, base + low, side="right") - 1
        known = np.maximum(run, 0)
        offset = low - self.first[known]
        inside = (run >= 0) & (self.head[known] == symbol) & (offset < self.length[known])
        after = np.minimum(run + 1, len(self.first) - 1)
        new_low = np.where(inside, self.target[known] + offset, self.target[after])
        new_place = np.where(inside, np.where(offset == 0, self.sample[known], place), self.sample[after]) - 1
        last = np.where(inside & (high <= self.first[known] + self.length[known]), known, -1)
        open_ = np.flatnonzero(last < 0)
        last[open_] = np.searchsorted(self.key, base[open_] + high[open_] - 1, side="right") - 1
        new_high = self.target[last] + np.minimum(high - self.first[last], self.length[last])
        several = np.flatnonzero(new_high - new_low > 1)
        context, known = self._repeated(new_low[several])
        new_place[several[known]] = self.first_place[context[known]]
        return new_low, new_high, new_place

    def _repeated(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The repeated context that begins at each row, and whether there is one."""
        if not len(self.repeated):
            return np.zeros(len(low), np.int64), np.zeros(len(low), bool)
        context = np.minimum(np.searchsorted(self.repeated, low), len(self.repeated) - 1)
        return context, self.repeated[context] == low

    def place(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The earliest place of the `window` symbols."""
        out = place.copy()
        several = np.flatnonzero(high - low > 1)
        out[several] = self.earliest[np.searchsorted(self.repeated, low[several])]
        return out
