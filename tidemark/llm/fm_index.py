"""FM-index over the pieces of one shard: a wavelet matrix answers rank, backward search the rest.

Suffixes are sorted by their first `window` symbols, equal ones by position, which is all that a
search for up to `window` symbols needs. Rows that share those symbols are neighbours with the
earliest first, so only the first row of each such class keeps a sampled position.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and one running count for each."""

    def __init__(self, bits: np.ndarray) -> None:
        words = np.zeros((len(bits) >> 6) + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol in one bit vector for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> level) & 1 == 1
            self.levels.append((level, Bits(ones), int(len(ones) - np.count_nonzero(ones))))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        counts = np.bincount(symbols, minlength=alphabet)
        order = np.full(alphabet, -1, np.int64)
        first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
        order[symbols[first]] = first
        self.first, self.counts = order, counts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place; every symbol occurs."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at - self.first[symbol]


def ranks_by_doubling(text: np.ndarray, window: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rank of every suffix by its first `window` symbols, and those for the powers of two below."""
    ranks, width = {1: text.astype(np.int64)}, 1
    while width * 2 <= window:
        ranks[width * 2] = _paired(ranks[width], width)
        width *= 2
    return (ranks[width] if width == window else _paired(ranks[width], window - width)), ranks


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    key = rank * (int(rank.max()) + 1)
    key[:-step] += rank[step:]
    return np.unique(key, return_inverse=True)[1]


def starts_of(order: np.ndarray, ranks: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Marks the rows, in suffix order, whose first `size` symbols differ from those of the row before."""
    if size == 0:
        new = np.zeros(len(order), bool)
    else:
        width = max(w for w in ranks if w <= size)
        padded = np.concatenate((ranks[width], np.zeros(size, np.int64)))
        head, tail = padded[order], padded[order + size - width]
        new = np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
    new[0] = True
    return new


def spread(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of each row's class, from the marks of first rows."""
    at = np.flatnonzero(starts)
    number = np.cumsum(starts) - 1
    return at[number], np.concatenate((at[1:], [len(starts)]))[number]


class FMIndex:
    """`symbols` are small integers from 1; pieces end in 0 and windows never cross an end."""

    def __init__(self, text: np.ndarray, window: int) -> None:
        rank, ranks = ranks_by_doubling(text, window)
        order = np.argsort(rank, kind="stable")
        alphabet = int(text.max()) + 1
        self.window, self.rows = window, len(text)
        self.bwt = WaveletMatrix(text[order - 1], alphabet)
        self.before = np.concatenate(([0], np.cumsum(self.bwt.counts)))[:-1]
        self.wider = spread(starts_of(order, ranks, window - 1))
        classes = starts_of(order, ranks, window)
        self.classes = Bits(classes)
        self.samples = order[classes]

    def start(self, streams: int) -> tuple[np.ndarray, ...]:
        return np.zeros(streams, np.int64), np.full(streams, self.rows)

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Drops the last of `window` symbols."""
        return self.wider[0][low], self.wider[1][low]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """One backward step: the rows that start with `symbol` and then the rows' own match."""
        both = self.bwt.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        both += np.concatenate((self.before[symbol], self.before[symbol]))
        return both[: len(low)], both[len(low) :]

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The earliest place of the `window` symbols."""
        return self.samples[self.classes.rank(low + 1) - 1]


def in_runs(begins: np.ndarray, lengths: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts pieces into runs of at most `run` windows; neighbours share window - 1 symbols, so no window is lost."""
    runs = np.maximum(1, -(-(lengths - window + 1) // run))
    skipped = (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)) * run
    return np.repeat(begins, runs) + skipped, np.minimum(np.repeat(lengths, runs) - skipped, run + window - 1)


def stream(index, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of all pieces at once, from right to left.

    Every run of `run` windows is a stream with its own row interval, so a long piece takes no more
    steps than that. A step drops the last symbol once the match
    has `window` of them, then extends it to the left. Returns, for each position of `text`, the
    earliest place of the `window` symbols from there (-1: none) and how often they occur.
    """
    found = np.full(len(text), -1, np.int64)
    times = np.zeros(len(text), np.int64)
    begins, lengths = in_runs(begins, lengths, window, run)
    by_length = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[by_length], lengths[by_length]
    state = index.start(len(begins))
    for step in range(int(lengths[0])):
        live = int(np.searchsorted(-lengths, -step, side="left"))
        state = tuple(x[:live] for x in state)
        at = begins[:live] + lengths[:live] - 1 - step
        if step >= window:
            state = index.shorten(*state)
        state = index.step(text[at], *state)
        if step >= window - 1:
            found[at] = index.place(*state)
            times[at] = state[1] - state[0]
    return found, times
