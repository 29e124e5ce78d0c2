"""Packing plans by bin completion: branch and bound over counts of lengths.

A plan needs only how many items there are of each length, so its size depends on the capacity and
not on the number of items. Bins are completed one kind at a time: around the largest length left,
the undominated fillings of its remaining room are enumerated, best fit first; a filling is applied
to as many bins at once as the counts allow. Branches that cannot beat the incumbent by the waste
bound are pruned. The first incumbent is best-fit decreasing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Plan:
    """(bins, {length: copies in each bin}) in order."""

    kinds: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return sum(n for n, _ in self.kinds)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and, for every k, big items plus the volume that cannot join them."""
    length = np.arange(capacity + 1)
    volume, number = counts * length, counts
    best = -(-int(volume.sum()) // capacity)
    above = np.concatenate((np.cumsum(number[::-1])[::-1], [0]))
    volume_above = np.concatenate((np.cumsum(volume[::-1])[::-1], [0]))
    half = capacity // 2 + 1
    for k in range(1, capacity // 2 + 1):
        big, middle = int(above[capacity - k + 1]), int(above[half] - above[capacity - k + 1])
        room = middle * capacity - int(volume_above[half] - volume_above[capacity - k + 1])
        rest = int(volume_above[k] - volume_above[half]) - room
        best = max(best, big + middle + max(0, -(-rest // capacity)))
    return best


def _fillings(counts: np.ndarray, room: int, keep: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill `room`, least waste and then largest items first, at most `keep`.

    An item that fills the room alone dominates every other filling. Otherwise each choice of a
    largest item is completed greedily from the best pair, then extended while something fits.
    """
    lengths = np.flatnonzero(counts[: room + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return [()]
    if lengths[-1] == room:
        return [(room,)]
    fits = np.zeros(room + 1, np.int64)  # the largest length at hand up to each size
    fits[lengths] = lengths
    fits = np.maximum.accumulate(fits)
    partner = fits[room - lengths]
    # a second copy of a length that is there once doesn't count
    alone = (partner == lengths) & (counts[lengths] < 2)
    partner[alone] = fits[np.maximum(np.minimum(room - lengths[alone], lengths[alone] - 1), 0)]
    waste = room - lengths - partner
    order = np.lexsort((-np.maximum(lengths, partner), waste))
    found: list[tuple[int, ...]] = []
    for i in order[: 2 * keep]:
        items = [int(lengths[i])] + ([int(partner[i])] if partner[i] else [])
        left = room - sum(items)
        while left > 0 and (size := int(fits[left])) > 0:
            while size > 0 and items.count(size) >= counts[size]:
                size = int(fits[size - 1])
            if size == 0:
                break
            items.append(size)
            left -= size
        filling = tuple(sorted(items, reverse=True))
        if filling not in found:
            found.append(filling)
        if len(found) == keep:
            break
    return sorted(found, key=lambda f: (room - sum(f), [-x for x in f]))


def _apply(counts: np.ndarray, largest: int, filling: tuple[int, ...]) -> tuple[int, tuple[tuple[int, int], ...]]:
    """Uses up the filling around the largest length in as many bins as there are items for."""
    copies: dict[int, int] = {largest: 1}
    for x in filling:
        copies[x] = copies.get(x, 0) + 1
    bins = min(int(counts[x]) // n for x, n in copies.items())
    for x, n in copies.items():
        counts[x] -= bins * n
    return bins, tuple(sorted(copies.items(), reverse=True))


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over the counts: every bin takes the largest that still fits."""
    counts, plan = counts.copy(), Plan()
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            room, filling = capacity - largest, []
            while room and len(at := np.flatnonzero(counts[1 : room + 1])):
                size = int(at[-1]) + 1
                each = min(room // size, int(counts[size]))
                filling += [size] * each
                counts[size] -= each
                room -= each * size
            for x in (largest, *filling):
                counts[x] += 1
            plan.kinds.append(_apply(counts, largest, tuple(filling)))
    return plan


def complete(counts: np.ndarray, capacity: int, width: int = 4, nodes: int = 20_000) -> tuple[Plan, int]:
    """The best plan found and the lower bound; equal means optimal.

    `width` fillings are tried around each largest length and at most `nodes` completions in all:
    that limits the search for a better plan, never the items packed.
    """
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    stack: list[tuple[np.ndarray, list, int]] = [(counts.copy(), [], 0)]
    while stack and best.bins > bound and nodes > 0:
        left, kinds, used = stack.pop()
        while nodes > 0:
            at = np.flatnonzero(left[1:])
            volume = int((left * np.arange(capacity + 1)).sum())
            if used + -(-volume // capacity) >= best.bins:
                break  # cannot beat the incumbent
            if not len(at):
                best = Plan(kinds)
                break
            nodes -= 1
            largest = int(at[-1]) + 1
            left[largest] -= 1
            options = _fillings(left, capacity - largest, width)
            left[largest] += 1
            for other in reversed(options[1:]):
                branch = left.copy()
                kind = _apply(branch, largest, other)
                stack.append((branch, [*kinds, kind], used + kind[0]))
            del stack[: max(0, len(stack) - 64)]
            kind = _apply(left, largest, options[0])
            kinds, used = [*kinds, kind], used + kind[0]
    return best, bound
