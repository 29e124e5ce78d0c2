"""Training-order materialisation: token sequences in fixed-stride binary shards.

Documents are tokenised once and cut into sequences of at most `length` tokens; the sequences are
staged in the shared folder, each numbered by its place there. A Feistel network under a key, walked
until it lands below the number of sequences, turns that number into the global slot. Slots are cut
into shards of equal size; one task writes each shard as one file of `length` 16-bit ids a record, so
slot s is record s % per_shard of shard s // per_shard and a reader can start at any slot and go on
sequentially. The permutation spreads every document and source evenly, so shards are even too.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_folder, staged

from .common import col, groups_for, mix
from .word_tokens import word_tokens

_CHUNK = 1 << 20
ROUNDS = 6
LEVEL = 6  # of compression between the steps; the shards themselves are plain


class Permutation:
    """A keyed bijection of range(size): a Feistel network on the next even number of bits, cycle-walked."""

    def __init__(self, size: int, key: int) -> None:
        self.size = size
        self.half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + mix(np.array([key % (1 << 64)], np.uint64)))

    def _walk(self, value: np.ndarray, back: bool) -> np.ndarray:
        out = value.astype(np.uint64)
        open_ = np.arange(len(out))
        while len(open_):
            left, right = out[open_] >> self.half, out[open_] & self.mask
            for k in self.keys[::-1] if back else self.keys:
                if back:
                    left, right = right ^ (mix(left + k) & self.mask), left
                else:
                    left, right = right, left ^ (mix(right + k) & self.mask)
            out[open_] = left << self.half | right
            open_ = open_[out[open_] >= self.size]
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


@dataclass(frozen=True)
class Layout:
    """What a reader needs to know; kept as manifest.json beside the shards."""

    folder: str
    size: int
    length: int
    per_shard: int
    key: int

    def file(self, shard: int) -> str:
        return f"{self.folder.rstrip('/')}/shard-{shard:08d}.bin"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _write(path: str, data: bytes) -> None:
    """Writes beside the place and moves there, so that a repeated task replaces a whole file."""
    system, place = _system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, place)


def _sequences(docs: DataFrame, path: str, length: int, end: int) -> DataFrame:
    """Runs of sequences: (part, before, count, doc_id, piece, lengths, tokens), numbered within the input partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, before = word_tokens(path), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            begin = 0
            while begin < len(texts):
                last, size = begin + 1, len(texts[begin])
                while last < len(texts) and size + len(texts[last]) <= _CHUNK:
                    size += len(texts[last])
                    last += 1
                owner, piece, sizes, flat = [], [], [], []
                for number, ids in zip(numbers[begin:last], tokens.encode(texts[begin:last]), strict=True):
                    count = len(ids) // length + 1  # with the end token
                    owner += [number] * count
                    piece += range(count)
                    sizes += [length] * (count - 1) + [len(ids) + 1 - length * (count - 1)]
                    flat += [ids.astype(np.uint16), np.array([end], np.uint16)]
                row = {"part": part, "before": before, "count": len(sizes), "doc_id": owner, "piece": piece, "lengths": sizes, "tokens": pack.compress(np.concatenate(flat).tobytes())}
                before += len(sizes)
                begin = last
                yield pa.RecordBatch.from_pylist([row], schema)

    kinds = {"part": pa.int32(), "before": pa.int64(), "count": pa.int32(), "doc_id": pa.list_(pa.int64()), "piece": pa.list_(pa.int32()), "lengths": pa.list_(pa.int32()), "tokens": pa.binary()}
    schema = pa.schema(list(kinds.items()))
    source = docs.select(col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"))
    return source.mapInArrow(cut, "part int, before long, count int, doc_id array<long>, piece array<int>, lengths array<int>, tokens binary")


_MOVED = "shard int, slot binary, doc_id array<long>, piece binary, lengths binary, tokens binary"


def _deal(rows: DataFrame, layout: Layout, first: dict[int, int]) -> DataFrame:
    """Every run's sequences, one row for each shard they go to.

    `first` has the number of each input partition's first sequence, so the payload isn't joined.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(layout.size, layout.key)
        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                slot = order.slot(first[row["part"]] + row["before"] + np.arange(row["count"]))
                lengths, piece = np.array(row["lengths"], np.int32), np.array(row["piece"], np.int32)
                flat = np.frombuffer(unpack.decompress(row["tokens"]), np.uint16)
                ends = np.cumsum(lengths)
                shard = slot // layout.per_shard
                by_shard = np.argsort(shard, kind="stable")
                out = []
                for own in np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1):
                    data = np.concatenate([flat[ends[i] - lengths[i] : ends[i]] for i in own])
                    out.append({"shard": int(shard[own[0]]), "slot": slot[own].tobytes(), "doc_id": [row["doc_id"][i] for i in own], "piece": piece[own].tobytes(), "lengths": lengths[own].tobytes(), "tokens": pack.compress(data.tobytes())})
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("shard", pa.int32()), ("slot", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("piece", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary())])
    return rows.mapInArrow(dealt, _MOVED)


def _write_shard(rows: pa.Table, layout: Layout, end: int) -> pa.Table:
    """Writes one shard's file; returns where every sequence went, with the checksum of its ids in the file's image."""
    shard, unpack = rows.column("shard")[0].as_py(), zstandard.ZstdDecompressor()
    first = shard * layout.per_shard
    count = min(layout.per_shard, layout.size - first)
    slot, piece, lengths = (np.concatenate([np.frombuffer(x, k) for x in rows.column(n).to_pylist()]) for n, k in (("slot", np.int64), ("piece", np.int32), ("lengths", np.int32)))
    record = slot - first
    if len(record) != count or len(np.unique(record)) != count:
        raise ValueError(f"shard {shard} holds {len(record)} of {count} sequences")
    flat = np.concatenate([np.frombuffer(unpack.decompress(x), np.uint16) for x in rows.column("tokens").to_pylist()])
    image = np.full((count, layout.length), end, "<u2")
    ends = np.cumsum(lengths)
    within = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    image[np.repeat(record, lengths), within] = flat
    _write(layout.file(shard), image.tobytes())
    crc = [zlib.crc32(image[r, :n].astype("<u4").tobytes()) for r, n in zip(record.tolist(), lengths.tolist(), strict=True)]
    numbers = pa.concat_arrays([x.flatten() for x in rows.column("doc_id").chunks])
    columns = [numbers, pa.array(piece), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(slot), pa.array(np.full(count, shard, np.int32)), pa.array(record)]
    return pa.table(columns, names=["doc_id", "piece", "length", "ids_crc32", "slot", "shard", "record"])


def materialise(docs: DataFrame, path: str, length: int = 256, per_shard: int = 32_768, key: int = 0x7469646D, end: int = 1, folder: str | None = None) -> tuple[DataFrame, Layout]:
    """Writes all sequences of `docs` (doc_id, text); returns where each one is, and the layout.

    A document is its ids by the tokenizer at `path` and then `end`; its last sequence is padded with
    `end`. Null and empty texts are one sequence; repeated rows are written as often as they occur;
    long texts are cut, not shortened. Other columns play no part. Without documents no shard is
    written. Ids must fit 16 bits. `folder` defaults to a new one in the shared folder; a manifest
    there makes the shards readable on their own.
    """
    spark = docs.sparkSession
    runs = staged(_sequences(docs, path, length, end), "sequences")
    sizes = {r[0]: r[1] for r in runs.groupBy("part").agg(F.sum("count")).collect()}  # one row for each input partition
    layout = Layout(folder or shared_folder(spark, "token-shards"), sum(sizes.values()), length, per_shard, key)
    first, before = {}, 0
    for part in sorted(sizes):
        first[part] = before
        before += sizes[part]
    index = _deal(runs, layout, first).groupBy("shard").applyInArrow(lambda t: _write_shard(t, layout, end), "doc_id long, piece int, length long, ids_crc32 long, slot long, shard int, record long")
    index = staged(index, "token-index")
    manifest = {"size": layout.size, "length": length, "per_shard": per_shard, "key": key, "end": end, "kind": "<u2", "shards": groups_for(layout.size, per_shard) if layout.size else 0}
    _write(f"{layout.folder.rstrip('/')}/manifest.json", json.dumps(manifest).encode())
    return index, layout


def open_layout(folder: str) -> Layout:
    system, place = _system(f"{folder.rstrip('/')}/manifest.json")
    with system.open_input_stream(place) as source:
        found = json.loads(source.read())
    return Layout(folder, found["size"], found["length"], found["per_shard"], found["key"])


def read_from(layout: Layout, slot: int = 0, records: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, records x length ids) in training order from `slot` on; the next slot is all the state a reader keeps."""
    while slot < layout.size:
        system, place = _system(layout.file(slot // layout.per_shard))
        with system.open_input_file(place) as source:
            source.seek(slot % layout.per_shard * layout.length * 2)
            while data := source.read(records * layout.length * 2):
                block = np.frombuffer(data, "<u2").reshape(-1, layout.length)
                yield slot, block
                slot += len(block)
