"""Windows that repeat anywhere in a corpus, found by shards that each index their own pieces.

A window's least gram hash is its anchor, so equal windows share one. Neighbouring windows with the
same anchor form a piece. Documents are cut into parts of bounded size; the steps are

1. every part sends its distinct anchors to anchor shards, which reply to each part the anchors met
   twice or more in the corpus: no other window can repeat;
2. every part sends the pieces of those anchors, each distinct content once with its places, to
   piece shards: copies meet as one content, an anchor met very often is sent by single windows;
3. a shard builds its index over the distinct contents and streams them through it (but for those
   that no other content could match); windows whose match also starts earlier become spans, which
   go back to their part;
4. every part unites the spans of a document and cuts them out.

The parts are read from one exchange in steps 1, 2 and 4. No step holds more than one part, or one
shard's share of the pieces; an index never holds more than `index_symbols` unless one anchor needs
it, and anchors beyond `hot` places are split by window before.

Order and ties: rows without a document number come last; rows that repeat a number count as one
document, told apart only by the place in the text, and equal rows never remove each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, byte_values, col, groups_for, rolling, sequence_hash, sliding_min, text_bytes, word_hashes
from .fm_index import stream

PART, RANK, TIE = "_repeats_part", "_repeats_rank", "_repeats_tie"
_KEY_BITS = 48
_KEY = np.uint64((1 << _KEY_BITS) - 1)
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Scheme:
    """What a window is and how shards are sized."""

    window: int
    gram: int
    units: str  # "words" or "bytes"
    same_document: bool  # whether an earlier start in the same document counts
    index: Callable[[np.ndarray, int], object]
    part_bytes: int = 4 << 20
    shard_bytes: int = 16 << 20
    index_symbols: int = 1 << 20
    hot: int = 100_000


def in_parts(docs: DataFrame, scheme: Scheme, id: str, text: str) -> tuple[DataFrame, int]:
    """Rows with their part, order and a tie-breaking text hash; the number of shards for their size."""
    total = text_bytes(docs, text)
    rank, tie = F.coalesce(col(id).cast("long"), F.lit(LAST)), F.xxhash64(F.coalesce(col(text), F.lit("")))
    parts = groups_for(total, scheme.part_bytes)
    rows = docs.withColumns({RANK: rank, TIE: tie}).withColumn(PART, F.pmod(F.xxhash64(RANK, TIE), F.lit(parts)).cast("int"))
    return rows, groups_for(total, scheme.shard_bytes)


def texts_of(rows: pa.Table, text: str) -> list[bytes]:
    return [x or b"" for x in rows.column(text).cast(pa.large_binary()).to_pylist()]


def _chunks(texts: list[bytes], scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Unit hashes, each unit's text and its number there, over a bounded run of texts (one at least)."""
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= _CHUNK:
            size += len(texts[end])
            end += 1
        some = texts[begin:end]
        lengths = np.array([len(x) for x in some])
        if scheme.units == "words":
            units, at = word_hashes(b"\n".join(some))
            owner = np.searchsorted(np.cumsum(lengths + 1) - 1, at, side="right")
        else:
            units, owner = byte_values(b"".join(some)), np.repeat(np.arange(len(some)), lengths)
        count = np.bincount(owner, minlength=len(some))
        yield units, owner + begin, np.arange(len(units)) - (np.cumsum(count) - count)[owner]
        begin = end


def _pieces(units: np.ndarray, owner: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of every piece."""
    window = scheme.window
    if len(units) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    anchor = sliding_min(rolling(units, scheme.gram), window - scheme.gram + 1) >> np.uint64(64 - _KEY_BITS)
    whole = owner[: len(anchor)] == owner[window - 1 :]
    begins = whole.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    ends = whole.copy()
    ends[:-1] &= (anchor[1:] != anchor[:-1]) | ~whole[1:]
    first = np.flatnonzero(begins)
    return anchor[first], first, np.flatnonzero(ends) - first + 1


def _anchor_places(units: np.ndarray, owner: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The anchor at every place that holds one, so that a window repeated in one piece counts too."""
    window = scheme.window
    if len(units) < window:
        return np.zeros(0, np.uint64)
    width = window - scheme.gram + 1
    grams = rolling(units, scheme.gram)
    least = sliding_min(grams, width)
    least[owner[: len(least)] != owner[window - 1 :]] = 0
    edge = np.zeros(width - 1, np.uint64)
    most = ~sliding_min(~np.concatenate((edge, least, edge)), width)
    return grams[most == grams] >> np.uint64(64 - _KEY_BITS)


def _packed(keys: np.ndarray, extra: np.ndarray) -> bytes:
    """48-bit keys with 8 bits each, in seven bytes."""
    whole = keys | (extra.astype(np.uint64) << np.uint64(_KEY_BITS))
    return np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole = np.zeros((len(data) // 7, 8), np.uint8)
    whole[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    whole = whole.reshape(-1).view(np.uint64)
    return whole & _KEY, whole >> np.uint64(_KEY_BITS)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(shard[places[0]]), places


def _anchors(rows: pa.Table, text: str, scheme: Scheme, shards: int) -> pa.Table:
    anchors = _anchor_places if scheme.same_document else lambda *x: _pieces(*x)[0]
    found = [anchors(units, owner, scheme) for units, owner, _ in _chunks(texts_of(rows, text), scheme)]
    keys, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
    part = rows.column(PART)[0].as_py() if rows.num_rows else 0
    out = [(shard, part, _packed(keys[at], np.minimum(count[at], 255))) for shard, at in _by_shard(keys % np.uint64(shards))]
    return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), "part": pa.array([x[1] for x in out], pa.int32()), "keys": pa.array([x[2] for x in out], pa.binary())})


def _met_again(rows: pa.Table, scheme: Scheme) -> pa.Table:
    """To each part, those of its anchors that the corpus holds twice, marked if they are hot."""
    parts, packed = rows.column("part").to_pylist(), [_unpacked(x) for x in rows.column("keys").to_pylist()]
    keys, place = np.unique(np.concatenate([k for k, _ in packed]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([c for _, c in packed]).astype(float))
    out, begin = [], 0
    for part, (own, _) in zip(parts, packed, strict=True):
        met = total[place[begin : begin + len(own)]]
        begin += len(own)
        if (met > 1).any():
            out.append((part, _packed(own[met > 1], met[met > 1] > scheme.hot)))
    return pa.table({PART: pa.array([x[0] for x in out], pa.int32()), "keys": pa.array([x[1] for x in out], pa.binary())})


def _numbers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A number for every row's (rank, tie) among those of the part, and the ranks by row."""
    pairs = np.empty(rows.num_rows, dtype=[("rank", np.int64), ("tie", np.int64)])
    pairs["rank"], pairs["tie"] = rows.column(RANK).to_numpy(), rows.column(TIE).to_numpy()
    return np.unique(pairs, return_inverse=True)[1], pairs["rank"]


_PIECES = "shard int, part int, anchor binary, length binary, symbols binary, of binary, doc binary, rank binary, start binary"


def _cut(rows: pa.Table, replies: pa.Table, text: str, scheme: Scheme, shards: int) -> pa.Table:
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int32()] * 2 + [pa.binary()] * 7
    out: list[list] = [[] for _ in names]
    if rows.num_rows and replies.num_rows:
        keys, hot = (np.concatenate(x) for x in zip(*(_unpacked(x) for x in replies.column("keys").to_pylist()), strict=True))
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order] > 0
        number, rank = _numbers(rows)
        window, texts = scheme.window, texts_of(rows, text)
        pack = zstandard.ZstdCompressor(level=1)
        got: list[tuple[np.ndarray, ...]] = []
        symbols: list[np.ndarray] = []
        raw_of = None
        for units, owner, at in _chunks(texts, scheme):
            anchor, first, count = _pieces(units, owner, scheme)
            slot = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
            wanted = keys[slot] == anchor
            anchor, first, count, split = anchor[wanted], first[wanted], count[wanted], hot[slot[wanted]]
            if split.any():
                many = np.where(split, count, 1)
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                first, anchor, split = np.repeat(first, many) + within, np.repeat(anchor, many), np.repeat(split, many)
                count = np.where(split, 1, np.repeat(count, many))
            if not len(first):
                continue
            length = count + window - 1
            content = sequence_hash(units, first, length) ^ anchor
            anchor = np.where(split, content & _KEY, anchor)
            if scheme.units == "words":
                raw_of = units
            else:
                raw_of = np.frombuffer(b"".join(texts[owner[0] : owner[-1] + 1]), np.uint8)
            content_new, index, inverse = np.unique(content, return_index=True, return_inverse=True)
            ends = np.cumsum(length[index])
            within = np.arange(ends[-1]) - np.repeat(ends - length[index], length[index])
            symbols.append(raw_of[np.repeat(first[index], length[index]) + within])
            got.append((content_new, anchor[index], length[index], inverse, number[owner[first]], rank[owner[first]], at[first]))
        if got:
            content = np.concatenate([g[0] for g in got])
            anchor, length = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
            base = np.cumsum([0] + [len(g[0]) for g in got])
            of = np.concatenate([g[3] + b for g, b in zip(got, base[:-1], strict=True)])
            doc, ranks, start = (np.concatenate([g[i] for g in got]) for i in (4, 5, 6))
            flat = np.concatenate(symbols)
            begin = np.cumsum(length) - length
            _, index, inverse = np.unique(content, return_index=True, return_inverse=True)
            of = inverse[of]
            content, anchor, length, begin = content[index], anchor[index], length[index], begin[index]
            shard = anchor % np.uint64(shards)
            by_shard = dict(_by_shard(shard[of]))
            local = np.zeros(len(content), np.int64)
            part = rows.column(PART)[0].as_py()
            for s, own in _by_shard(shard):
                local[own] = np.arange(len(own))
                places = by_shard[s]
                ends = np.cumsum(length[own])
                within = np.arange(ends[-1]) - np.repeat(ends - length[own], length[own])
                row = (s, part, anchor[own], length[own].astype(np.int32), flat[np.repeat(begin[own], length[own]) + within], local[of[places]].astype(np.int32), doc[places].astype(np.int32), ranks[places], start[places].astype(np.int32))
                for column, value in zip(out, row, strict=True):
                    column.append(value if isinstance(value, int) else pack.compress(value.tobytes()))
    return pa.table({n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=True)})


def _content_hashes(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The hash of every content, a bounded run of neighbours (one at least) at a time: its arrays take many times the symbols."""
    out, ends, at = np.zeros(len(length), np.uint64), begin + length, 0
    while at < len(length):
        end = max(at + 1, int(np.searchsorted(ends, begin[at] + _CHUNK, side="right")))
        some = flat[begin[at] : ends[end - 1]]
        out[at:end] = sequence_hash(some if some.dtype == np.uint64 else byte_values(some.tobytes()), begin[at:end] - begin[at], length[at:end])
        at = end
    return out


def _settle(rows: pa.Table, scheme: Scheme) -> pa.Table:
    """Indexes the shard's distinct contents and turns windows that start earlier elsewhere into spans."""
    window = scheme.window
    kind = np.uint64 if scheme.units == "words" else np.uint8

    def column(name: str, dtype) -> list[np.ndarray]:
        return [np.frombuffer(unpack.decompress(x), dtype) for x in rows.column(name).to_pylist()]

    unpack = zstandard.ZstdDecompressor()
    anchors, symbols = column("anchor", np.uint64), column("symbols", kind)
    base = np.cumsum([0] + [len(x) for x in anchors])
    of = np.concatenate([x + b for x, b in zip(column("of", np.int32), base[:-1], strict=True)]).astype(np.int64)
    docs = column("doc", np.int32)
    part = np.repeat(rows.column("part").to_numpy(), [len(x) for x in docs])
    doc, rank, start = np.concatenate(docs), np.concatenate(column("rank", np.int64)), np.concatenate(column("start", np.int32)).astype(np.int64)
    length, anchor, flat = np.concatenate(column("length", np.int32)).astype(np.int64), np.concatenate(anchors), np.concatenate(symbols)
    begin = np.cumsum(length) - length
    content = _content_hashes(flat, begin, length) ^ anchor
    _, index, inverse = np.unique(content, return_index=True, return_inverse=True)
    of, length, anchor, begin = inverse[of], length[index], anchor[index], begin[index]

    by_first = np.lexsort((start, rank, of))
    head = by_first[np.concatenate(([True], np.diff(of[by_first]) > 0))]  # the earliest place of each content
    first_rank, first_start = rank[head], start[head]
    order = np.lexsort((first_start, first_rank, anchor))
    if not scheme.same_document:  # a content alone under its anchor can only match itself, which does not count
        _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
        order = order[members[group[order]] > 1]
    size = np.cumsum(length[order] + 1)
    same = np.concatenate(([False], anchor[order][1:] == anchor[order][:-1]))
    repeated_first: dict[int, np.ndarray] = {}
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + scheme.index_symbols, side="right")))
        while end < len(order) and same[end]:
            end += 1
        some = order[at:end]
        some = some[np.lexsort((first_start[some], first_rank[some]))]
        repeated_first.update(_earlier_windows(some, flat, begin, length, first_rank, first_start, scheme))
        at = end

    later = (rank > first_rank[of]) | ((rank == first_rank[of]) & (start > first_start[of]) if scheme.same_document else False)
    spans = [np.stack((part[later], doc[later], start[later], start[later] + length[of[later]]))]
    rest = np.flatnonzero(~later & np.isin(of, np.fromiter(repeated_first, np.int64, len(repeated_first))))
    for place in rest:
        for a, b in repeated_first[int(of[place])]:
            spans.append(np.array([[part[place]], [doc[place]], [start[place] + a], [start[place] + b + window - 1]]))
    part, doc, a, b = np.concatenate(spans, axis=1)
    groups = list(_by_shard(part))
    pack = lambda x: pa.array([x[at].astype(np.int32).tobytes() for _, at in groups], pa.binary())
    return pa.table({PART: pa.array([p for p, _ in groups], pa.int32()), "doc": pack(doc), "a": pack(a), "b": pack(b)})


def _earlier_windows(some: np.ndarray, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, rank: np.ndarray, start: np.ndarray, scheme: Scheme) -> Iterator[tuple[int, np.ndarray]]:
    """For contents in order of their first places: runs of windows that also start earlier."""
    window, lengths = scheme.window, length[some]
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    owner = np.repeat(np.arange(len(some)), lengths + 1)
    within = np.arange(ends[-1]) - begins[owner]
    real = within < lengths[owner]
    values = flat[(begin[some][owner] + within)[real]]
    text = np.zeros(ends[-1], np.int64)
    text[real] = (np.unique(values, return_inverse=True)[1] if scheme.units == "words" else values.astype(np.int64)) + 1
    place, _ = stream(scheme.index(text, window), text, begins, lengths, window)
    here = np.flatnonzero(place >= 0)
    there = place[here]
    mine, other = some[owner[here]], some[owner[there]]
    earlier = rank[other] < rank[mine]
    if scheme.same_document:
        earlier |= (rank[other] == rank[mine]) & (start[other] + within[there] < start[mine] + within[here])
    here = here[earlier]
    if not len(here):
        return
    cut = np.flatnonzero((np.diff(here) > 1) | (np.diff(owner[here]) > 0)) + 1
    heads, tails = here[np.concatenate(([0], cut))], here[np.concatenate((cut - 1, [len(here) - 1]))] + 1
    runs = np.stack((within[heads], within[tails - 1] + 1), axis=1)
    of = owner[heads]
    bounds = np.flatnonzero(np.diff(of)) + 1
    for group in np.split(np.arange(len(of)), bounds):
        yield int(some[of[group[0]]]), runs[group]


def _spans_by_row(rows: pa.Table, spans: pa.Table) -> list[np.ndarray | None]:
    """United spans of every row of the part."""
    number, _ = _numbers(rows)
    out: list[np.ndarray | None] = [None] * rows.num_rows
    if spans.num_rows:
        doc, a, b = (np.concatenate([np.frombuffer(x, np.int32) for x in spans.column(n).to_pylist()]).astype(np.int64) for n in ("doc", "a", "b"))
        order = np.lexsort((a, doc))
        doc, a, b = doc[order], a[order], b[order]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        own = {}
        for g in np.split(np.arange(len(doc)), cuts):
            left, right = a[g], np.maximum.accumulate(b[g])
            new = np.concatenate(([True], left[1:] > right[:-1]))
            own[int(doc[g[0]])] = np.stack((left[new], right[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(g) - 1]))]), axis=1)
        out = [own.get(int(n)) for n in number]
    return out


def without_repeats(docs: DataFrame, scheme: Scheme, finish: Callable[[pa.Table, list[np.ndarray | None]], pa.Table], schema, id: str, text: str) -> DataFrame:
    """`finish` turns a part's rows and their removed spans (in units) into the result rows."""
    rows, shards = in_parts(docs, scheme, id, text)
    parts = rows.groupBy(PART)
    anchors = parts.applyInArrow(lambda t: _anchors(t, text, scheme, shards), "shard int, part int, keys binary")
    met = anchors.groupBy("shard").applyInArrow(lambda t: _met_again(t, scheme), f"{PART} int, keys binary")
    pieces = parts.cogroup(met.groupBy(PART)).applyInArrow(lambda t, r: _cut(t, r, text, scheme, shards), _PIECES)
    spans = pieces.groupBy("shard").applyInArrow(lambda t: _settle(t, scheme), f"{PART} int, doc binary, a binary, b binary")
    return parts.cogroup(spans.groupBy(PART)).applyInArrow(lambda t, s: finish(t, _spans_by_row(t, s)), schema)
