"""Piece encoding that keeps every piece's place in the source, and the decoding of its ids.

A text is normalised by the model's compiled character map: at each place the longest key of the map
is replaced, any other character stands for itself, and spaces become the piece separator. Each byte
of the result remembers the source byte where its replacement began, so the bounds of every piece
project back to a span of the source.

The normalised text is cut between two characters that no piece of the model holds side by side. No
merge ever spans such a place, so equal units have equal pieces wherever they stand; a worker
remembers the units it has met lately, and merges the new ones of many texts together.
"""

from __future__ import annotations

import codecs
import heapq
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import plain

MARK, REPLACEMENT = "▁".encode(), "\ufffd".encode()
#: Fixed numbers of the model format: fields of the model, its normaliser, trainer and pieces, and kinds of pieces.
MODEL = {"pieces": 1, "trainer": 2, "normaliser": 3}
NORMALISER = {"map": 2, "dummy_prefix": 3, "remove_extra": 4, "escape": 5}
TRAINER = {"kind": 3, "suffix": 24, "byte_fallback": 35, "unknown_surface": 44}
PIECE = {"text": 1, "score": 2, "kind": 3}
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2

#: Units remembered by a worker, in each of two generations, and the bytes of those worth remembering.
_KEEP, _SHORT = 300_000, 64
#: Characters of a unit from which it is merged alone, with a heap.
_LONG = 48
#: Bytes of text taken together.
_CHUNK = 1 << 20
_BLANK = 0x20
_NEVER = (1 << 31) - 1


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of an encoded message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            if kind == 2:
                size, at = number(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


Unit = tuple[bytes, int, bytes, bytes]


class CharacterMap:
    """The compiled map: a double array of its keys' bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, data: bytes) -> None:
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist() if size else []
        self.pool = data[4 + size :]
        self.opens = np.zeros(256, bool)
        for byte in range(256):
            self.opens[byte] = self._step(0, byte) is not None if self.units else False

    def _step(self, node: int, byte: int) -> int | None:
        unit = self.units[node]
        child = node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6)) ^ byte
        return child if child < len(self.units) and self.units[child] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that begins at `at`."""
        node, found = 0, None
        for end in range(at, len(data)):
            node = self._step(node, data[end])
            if node is None:
                break
            unit = self.units[node]
            if unit >> 8 & 1:
                leaf = node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))
                begin = self.units[leaf] & 0x7FFFFFFF
                found = end + 1 - at, self.pool[begin : self.pool.index(b"\0", begin)]
        return found


def _literal(data: bytes, begin: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Characters that stand for themselves, with their places; a byte that is no UTF-8 becomes one replacement character."""
    while begin < end:
        try:
            codecs.utf_8_decode(memoryview(data)[begin:end], "strict", True)
            stop = end
        except UnicodeDecodeError as error:
            stop = begin + error.start
        if begin < stop:
            yield data[begin:stop], np.arange(begin, stop)
        if stop < end:
            yield REPLACEMENT, np.full(len(REPLACEMENT), stop)
        begin = stop + 1 if stop < end else end


class PieceModel:
    """Encodes and decodes by the merge model in the file at `path`, or given as `data`."""

    def __init__(self, path: str | None = None, data: bytes | None = None) -> None:
        if data is None:
            with open(path, "rb") as file:
                data = file.read()
        parts: dict[int, list] = {}
        for number, value in fields(data):
            parts.setdefault(number, []).append(value)
        trainer = dict(fields(parts.get(MODEL["trainer"], [b""])[0]))
        normaliser = dict(fields(parts.get(MODEL["normaliser"], [b""])[0]))
        if trainer.get(TRAINER["kind"], 1) != BPE or trainer.get(TRAINER["suffix"], 0):
            raise ValueError("only merge models with the separator before words are supported")
        self.map = CharacterMap(normaliser.get(NORMALISER["map"], b""))
        self.dummy_prefix = bool(normaliser.get(NORMALISER["dummy_prefix"], 1))
        self.remove_extra = bool(normaliser.get(NORMALISER["remove_extra"], 1))
        self.escaped = bool(normaliser.get(NORMALISER["escape"], 1))
        self.mark = MARK.decode() if self.escaped else " "
        self.unknown_surface = trainer.get(TRAINER["unknown_surface"], " ⁇ ".encode())
        self.pieces, self.kinds, scores = [], [], []
        for piece in parts[MODEL["pieces"]]:
            own = dict(fields(piece))
            self.pieces.append(own.get(PIECE["text"], b"").decode())
            scores.append(struct.unpack("<f", own.get(PIECE["score"], bytes(4)))[0])
            self.kinds.append(own.get(PIECE["kind"], NORMAL))
        if DEFINED in self.kinds or UNUSED in self.kinds or not trainer.get(TRAINER["byte_fallback"], 0):
            raise ValueError("models with user-defined or unused pieces, or without byte pieces, are not supported")
        self.byte_of = {i: int(p[3:5], 16) for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        order = {x: r for r, x in enumerate(sorted(set(scores), reverse=True))}
        rank = {p: order[scores[i]] for p, i in self.id.items()}
        self.merge = {(p[:i], p[i:]): (r, p) for p, r in rank.items() for i in range(1, len(p))}
        self._arrays(rank)
        self.young: dict[bytes, Unit] = {}
        self.old: dict[bytes, Unit] = {}

    def _arrays(self, rank: dict[str, int]) -> None:
        """Merges as sorted pairs of symbol numbers, and which bytes may stand side by side inside a piece."""
        parts = {c for p in self.id for c in p} | {x for pair in self.merge for x in pair}
        self.symbols = [*self.id, *sorted(parts - self.id.keys())]
        number = {p: i for i, p in enumerate(self.symbols)}
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs = sorted((number[a] * len(number) + number[b], r, number[p]) for (a, b), (r, p) in self.merge.items())
        self.pair, self.pair_rank, self.pair_into = (np.array(x, np.int64) for x in zip(*[*pairs, (1 << 62, _NEVER, -1)], strict=True))
        self.symbol_id = np.array([self.id.get(p, -1) for p in self.symbols], np.int64)
        self.symbol_size = np.array([len(p.replace(self.mark, " ").encode()) for p in self.symbols], np.int64)
        self.names = [str(i).encode() for i in range(len(self.pieces))]
        self.surface = [bytes([self.byte_of[i]]) if k == BYTE else p.replace(self.mark, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.beside = np.zeros(1 << 16, bool)
        for p in self.id:
            raw = np.frombuffer(p.replace(self.mark, " ").encode(), np.uint8).astype(np.uint16)
            self.beside[(raw[:-1] << 8) | raw[1:]] = True
        self.beside.reshape(256, 256)[:, 0x80:0xC0] = True

    # Normalisation

    def normalise(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes of one text, separators as spaces; the source place of each, right where a character begins, and the place after the last."""
        parts, begins, at = [], [], 0

        def add(begin: int, found: list[tuple[bytes, np.ndarray]]) -> None:
            for text, places in found:
                parts.append((text, places))
                begins.append(int(places[0]) if len(places) else begin)

        if self.map.units:
            for hit in np.flatnonzero(self.map.opens[np.frombuffer(data, np.uint8)]).tolist():
                if hit >= at and (found := self.map.longest(data, hit)):
                    add(at, list(_literal(data, at, hit)))
                    add(hit, [(found[1], np.full(len(found[1]), hit))])
                    at = hit + found[0]
        add(at, list(_literal(data, at, len(data))))
        start = 0  # the prefix stands where the text begins, behind spaces that are dropped
        if self.remove_extra:
            start = next((begin + len(text) - len(text.lstrip(b" ")) for (text, _), begin in zip(parts, begins, strict=True) if text.strip(b" ") or not text), len(data))
        raw = np.frombuffer(b"".join([x for x, _ in parts]), np.uint8)
        return self._spaced(raw, np.concatenate([*[x for _, x in parts], [len(data)]]).astype(np.int64), start)

    def _spaced(self, raw: np.ndarray, place: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Spaces dropped where the model says so, separators in the text as spaces, and the prefix."""
        if self.remove_extra and len(raw):
            blank = raw == _BLANK
            keep = ~(blank & np.append(True, blank[:-1]))
            raw, place = raw[keep], np.append(place[:-1][keep], place[-1])
        if self.escaped and MARK in (text := raw.tobytes()):
            at = np.flatnonzero((raw[:-2] == MARK[0]) & (raw[1:-1] == MARK[1]) & (raw[2:] == MARK[2]))
            raw, keep = raw.copy(), np.ones(len(text), bool)
            raw[at], keep[at + 1], keep[at + 2] = _BLANK, False, False
            raw, place = raw[keep], np.append(place[:-1][keep], place[-1])
        if self.remove_extra:
            size = int(np.flatnonzero(raw != _BLANK)[-1]) + 1 if (raw != _BLANK).any() else 0
            raw, place = raw[:size], place[: size + 1]
        if self.dummy_prefix and len(raw):
            raw, place = np.append(np.uint8(_BLANK), raw), np.append(start, place)
        return raw, place

    # Merging: the best-scored pair of a unit first, the leftmost of equal ones

    def _alone(self, text: str) -> list[str]:
        """The pieces of one unit of any length, by a heap over linked symbols."""
        parts, size = list(text), len(text)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(found[0], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if (found := self.merge.get(pair))]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j >= size or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = self.merge[pair][1], ""
            right[i] = right[j]
            if right[i] < size:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < size:
                    pair = (parts[a], parts[right[a]])
                    if found := self.merge.get(pair):
                        heapq.heappush(heap, (found[0], a, pair))
        return [p for p in parts if p]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; negative symbols never merge."""
        key = np.where((left < 0) | (right < 0), -1, left * len(self.symbols) + right)
        at = np.searchsorted(self.pair, key)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], _NEVER), self.pair_into[at]

    def _together(self, symbol: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges many units at a time, one pair of each in a round. Units are numbered upward; so is the result."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = self._pairs(symbol[:-1], symbol[1:])
        rank[unit[:-1] != unit[1:]] = _NEVER
        rank, into = np.append(rank, _NEVER), np.append(into, -1)
        while len(symbol):
            starts = np.flatnonzero(np.diff(unit, prepend=-1))
            least = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            ended = least >> 32 == _NEVER
            if ended.any():
                over = np.repeat(ended, np.diff(starts, append=len(unit)))
                done.append((unit[over], symbol[over]))
                shift = np.cumsum(over)
                symbol, unit, rank, into = symbol[~over], unit[~over], rank[~over], into[~over]
                least = least[~ended]
                if not len(symbol):
                    break
                spot = (least & 0xFFFFFFFF) - shift[least & 0xFFFFFFFF]
            else:
                spot = least & 0xFFFFFFFF
            symbol[spot] = into[spot]
            keep = np.ones(len(symbol), bool)
            keep[spot + 1] = False
            spot = spot - np.arange(len(spot))  # one symbol goes in each unit before
            symbol, unit, rank, into = symbol[keep], unit[keep], rank[keep], into[keep]
            touched = np.concatenate((spot, spot[spot > 0] - 1))
            touched = touched[touched + 1 < len(symbol)]
            found, become = self._pairs(symbol[touched], symbol[touched + 1])
            rank[touched] = np.where(unit[touched] == unit[touched + 1], found, _NEVER)
            into[touched] = become
            rank[-1] = _NEVER
        order = np.argsort(np.concatenate([u for u, _ in done]), kind="stable")
        return np.concatenate([s for _, s in done])[order], np.concatenate([u for u, _ in done])[order]

    def _learn(self, units: list[bytes]) -> dict[bytes, Unit]:
        """Ids as text joined by commas, their number, each one's bytes, and the ids decoded, of every unit."""
        text = b"".join(units).decode()
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        chars = np.where(chars == _BLANK, ord(self.mark), chars)
        heads = np.frombuffer(b"".join(units), np.uint8) & 0xC0 != 0x80
        counts = np.diff(np.append(0, np.cumsum(heads))[np.cumsum([0, *map(len, units)])])
        unit = np.repeat(np.arange(len(units)), counts)
        symbol = self.of_char[chars]
        symbol = np.where(symbol < 0, -1 - chars, symbol)
        short = np.repeat(counts <= _LONG, counts)
        symbol, unit = self._together(symbol[short], unit[short]) if short.any() else (symbol[:0], unit[:0])
        bounds = np.searchsorted(unit, np.arange(len(units) + 1))
        known = symbol >= 0
        ids = np.where(known, self.symbol_id[np.maximum(symbol, 0)], -1).tolist()
        sizes = np.where(known, self.symbol_size[np.maximum(symbol, 0)], 0).astype("<u4").tobytes()
        bounds, names, surface, out = bounds.tolist(), self.names, self.surface, {}
        for data, a, b in zip(units, bounds[:-1], bounds[1:], strict=True):
            own, size = ids[a:b], sizes[4 * a : 4 * b]
            if a == b or -1 in own:
                parts = self._alone(data.decode().replace(" ", self.mark)) if a == b else [self.symbols[x] if x >= 0 else chr(-1 - x) for x in symbol[a:b].tolist()]
                own, size = self._with_bytes(parts)
            out[data] = b",".join([names[i] for i in own]), len(own), size, b"".join([surface[i] for i in own])
        return out

    def _with_bytes(self, parts: list[str]) -> tuple[list[int], bytes]:
        """Ids and sizes where characters without a piece are written as bytes, the last of which holds them whole."""
        ids, sizes = [], []
        for part in parts:
            raw = part.replace(self.mark, " ").encode()
            if part in self.id:
                ids.append(self.id[part])
                sizes.append(len(raw))
            else:
                ids += [self.byte_ids[x] for x in part.encode()]
                sizes += [0] * (len(part.encode()) - 1) + [len(raw)]
        return ids, np.array(sizes, "<u4").tobytes()

    def _units(self, raw: np.ndarray) -> list[bytes]:
        """The normalised text, cut where no piece can span."""
        text, wide = raw.tobytes(), raw.astype(np.uint16)
        cuts = (np.flatnonzero(~self.beside[(wide[:-1] << 8) | wide[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def encode(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes, np.ndarray, np.ndarray]]:
        """For each text: the number of ids, the ids as text joined by commas, the ids decoded, and where each piece begins and ends."""
        out = []
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and size + len(texts[end]) <= _CHUNK:
                size += len(texts[end])
                end += 1
            out += self._encode(texts[begin:end])
            begin = end
        return out

    def _encode(self, texts: list[bytes]) -> list[tuple[int, bytes, bytes, np.ndarray, np.ndarray]]:
        normal = [self.normalise(x) for x in texts]
        units = [self._units(raw) if len(raw) else [] for raw, _ in normal]
        new = set().union(*units).difference(self.young)
        if len(self.young) + len(new) > _KEEP:
            self.young, self.old = {}, self.young
            new = set().union(*units)
        held = {u: self.old[u] for u in new if u in self.old}
        held |= self._learn([u for u in new if u not in held]) if len(held) < len(new) else {}
        self.young.update((u, x) for u, x in held.items() if len(u) <= _SHORT)
        get, out = self.young.get, []
        for own, (_, place) in zip(units, normal, strict=True):
            if not own:
                out.append((0, b"", b"", place[:0], place[:0]))
                continue
            ids, count, sizes, decoded = zip(*[get(u) or held[u] for u in own], strict=True)
            bounds = np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(sizes), "<u4"), dtype=np.int64)))
            head = self.decode([int(i) for i in ids[0].split(b",")])
            out.append((sum(count), b",".join(ids), b"".join([head, *decoded[1:]]), place[bounds[:-1]], place[bounds[1:]]))
        return out

    # Decoding

    def decode(self, ids: list[int], first: bool = True) -> bytes:
        """The text of ids: separators as spaces, without the prefix's where they are the `first` of a text.

        Byte pieces that follow each other are joined; bytes that are no UTF-8 become one replacement
        character each.
        """
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out += [text for text, _ in _literal(bytes(run), 0, len(run))]
                run, first = bytearray(), False
            if i is None or self.kinds[i] == CONTROL:
                continue
            if self.kinds[i] == UNKNOWN:
                out.append(self.unknown_surface)
                first = False
                continue
            piece = self.surface[i]
            if first and piece.startswith(b" ") and (self.dummy_prefix or self.remove_extra):
                piece = piece[1:]
                first = self.remove_extra and not piece
            elif piece:
                first = False
            out.append(piece)
        return b"".join(out)


def piece_model(path: str) -> PieceModel:
    """One model for each file and Python worker, kept between its tasks."""
    held = sys.modules.setdefault("_tidemark_pieces", types.ModuleType("_tidemark_pieces")).__dict__
    if path not in held:
        held[path] = PieceModel(path)
    return held[path]


OUTPUTS = [
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType()),
    T.StructField("n_spanned", T.LongType()), T.StructField("begins", T.ArrayType(T.IntegerType(), False)), T.StructField("ends", T.ArrayType(T.IntegerType(), False)),
]


def encode_pieces(docs: DataFrame, path: str, text: str = "text", spans: bool = True) -> DataFrame:
    """The rows of `docs` with `n_tokens`, `ids` (decimal, joined by commas), `decoded` and the pieces' source bytes.

    Piece i stands for bytes begins[i] to ends[i] of the text; spans follow each other, and only the
    last byte piece of a character has one. `n_spanned` is their sum. `spans=False` leaves the two
    arrays out. Null and empty texts have no tokens; long texts and words are encoded whole; equal
    texts get equal ids. Input columns named like an output, in whatever case, are replaced, all
    others passed on; an empty table gives an empty result.
    """
    fields = OUTPUTS if spans else OUTPUTS[:-2]
    outputs = [f.name for f in fields]
    docs, names, (text,) = plain(docs, outputs, text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for whole in batches:
            for part in _slices(whole, text):
                rows = model.encode([x.as_py() or b"" for x in part.column(text).cast(pa.large_binary())])
                n, ids, decoded, begins, ends = zip(*rows, strict=True)
                extra = [pa.array(n, pa.int64()), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary()).cast(pa.string())]
                extra.append(pa.array([int((e - b).sum()) for b, e in zip(begins, ends, strict=True)], pa.int64()))
                if spans:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                    extra += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (begins, ends)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, *outputs])

    return docs.mapInArrow(encoded, T.StructType([*docs.schema.fields, *fields])).toDF(*names, *outputs)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `_CHUNK` bytes of text each, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin = size = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and size + n > _CHUNK:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
