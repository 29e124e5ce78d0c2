"""Byte-level BPE by recursive DuckDB queries, one database in each Python worker.

Each recursion opens the words still unknown to the worker to token-position rows, joins neighbouring
tokens with the merge table and contracts every word's leftmost pair of minimum rank, until no pair
of a word is in the table. An ordered aggregation decodes the ids. A step for each contraction costs
the square of a word's length, so words of `LONG` bytes or more are contracted in the same order by a
heap instead.

Equal matches of the pre-tokenising pattern have equal ids wherever they stand. The worker remembers
the words it has met lately, also from one task to the next: two generations, the older of which goes
when the younger one is full. New words of many texts are contracted together.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import plain

#: Words remembered, in each of two generations.
KEEP = 400_000
#: Bytes of a word from which a heap contracts it.
LONG = 256
_CHUNK = 4 << 20

#: `byte_rows` (word, tokens in order); `merges` (l, r, m): ranks are ids, so m is also the pair's rank.
#: Every step opens the words of the last one to token positions; a word's row replaces the one before.
CONTRACT = """
WITH RECURSIVE state(word, tokens) USING KEY (word) AS (
  SELECT word, tokens FROM byte_rows
  UNION
  SELECT state.word, list_concat(list_append(state.tokens[:(best & 4294967295) - 1], best >> 32), state.tokens[(best & 4294967295) + 2:])
  FROM state JOIN (
    SELECT word, min(m * 4294967296 + pos) AS best
    FROM (SELECT word, unnest(range(1, len(tokens))) AS pos, unnest(tokens[:-2]) AS token, unnest(tokens[2:]) AS follows FROM state WHERE len(tokens) > 1)
    JOIN merges ON merges.l = token AND merges.r = follows
    GROUP BY word
  ) USING (word)
)
SELECT word, array_to_string(tokens, ' ') AS ids, len(tokens) AS n FROM state
"""
DECODED = "SELECT unit, string_agg(hex, '' ORDER BY spot) AS hex FROM unit_ids JOIN vocabulary ON id = token GROUP BY unit"


#: Ids as text, their number and the decoded bytes.
Known = tuple[bytes, int, bytes]


class Encoder:
    """Encodes and decodes units of text with the ranks in the file at `path`."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        triples = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({"l": [x[0] for x in triples], "r": [x[1] for x in triples], "m": [x[2] for x in triples]})  # noqa: F841
        vocabulary = pa.table({"id": list(ranks.values()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.pair = {(a, b): m for a, b, m in triples}
        # Within its memory or not at all: no files beside those of Spark.
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.words: dict[str, Known] = {}
        self.old_words: dict[str, Known] = {}

    def contract(self, words: list[bytes]) -> dict[int, tuple[bytes, int]]:
        """Ids as text and their number, for each word by its place in the list."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        byte_rows = pa.table({"word": np.arange(len(words)), "tokens": pa.ListArray.from_arrays(bounds, pa.array(self.single[raw]))})  # noqa: F841
        found = self.db.sql(CONTRACT).to_arrow_table()
        return {i: (ids.encode(), n) for i, ids, n in zip(*(found.column(c).to_pylist() for c in ("word", "ids", "n")), strict=True)}

    def contract_long(self, word: bytes) -> tuple[bytes, int]:
        """The same of one word, by a heap over linked tokens."""
        tokens, size = [int(x) for x in self.single[np.frombuffer(word, np.uint8)]], len(word)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(m, i, pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if (m := self.pair.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, pair = heapq.heappop(heap)
            j = right[i]
            if j >= size or (tokens[i], tokens[j]) != pair:
                continue
            tokens[i], tokens[j], right[i] = m, -1, right[j]
            if right[i] < size:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < size:
                    pair = tokens[a], tokens[right[a]]
                    if (m := self.pair.get(pair)) is not None:
                        heapq.heappush(heap, (m, a, pair))
        ids = [t for t in tokens if t >= 0]
        return " ".join(map(str, ids)).encode(), len(ids)

    def learn(self, new: list[str]) -> dict[str, Known]:
        """The ids as text, their number and the decoded bytes of each word."""
        words = [w.encode() for w in new]
        ids = {i: (b"%d" % self.ranks[w], 1) for i, w in enumerate(words) if w in self.ranks}
        ids |= {i: self.contract_long(w) for i, w in enumerate(words) if len(w) >= LONG and i not in ids}
        rest = [i for i in range(len(words)) if i not in ids]
        if rest:
            ids |= {rest[i]: x for i, x in self.contract([words[i] for i in rest]).items()}
        decoded = self.decode([ids[i][0] for i in range(len(words))])
        return {w: (*ids[i], decoded[i]) for i, w in enumerate(new)}

    def decode(self, texts: list[bytes]) -> dict[int, bytes]:
        """The bytes of each run of decimal ids."""
        rows = [x.split() for x in texts]
        sizes = [len(x) for x in rows]
        unit_ids = pa.table({  # noqa: F841
            "unit": np.repeat(np.arange(len(rows)), sizes),
            "spot": np.concatenate([np.arange(n) for n in sizes]),
            "token": np.array([i for x in rows for i in x], dtype="S").astype(np.int64),
        })
        found = self.db.execute(DECODED).fetchall()
        return {i: bytes.fromhex(h) for i, h in found}

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by one space, decoded bytes) of each text."""
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin])
            while end < len(texts) and size + len(texts[end]) <= _CHUNK:
                size += len(texts[end])
                end += 1
            yield from self._encode(texts[begin:end])
            begin = end

    def _encode(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        words = [self.pattern.findall(text.decode()) for text in texts]
        new = set().union(*words).difference(self.words)
        if len(self.words) + len(new) > KEEP:
            self.words, self.old_words = {}, self.words
            new = set().union(*words)
        held = {w: self.old_words[w] for w in new if w in self.old_words}
        if len(held) < len(new):
            held |= self.learn([w for w in new if w not in held])
        self.words.update((w, x) for w, x in held.items() if len(x[2]) < LONG)
        get = self.words.get
        for own in words:
            if own:
                ids, count, data = zip(*[get(w) or held[w] for w in own], strict=True)
                yield sum(count), b" ".join(ids), b"".join(data)
            else:
                yield 0, b"", b""


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary and Python worker, kept between its tasks."""
    held = sys.modules.setdefault("_tidemark_encoders", types.ModuleType("_tidemark_encoders")).__dict__
    if (path, pattern) not in held:
        held[path, pattern] = Encoder(path, pattern)
    return held[path, pattern]


OUTPUTS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of `docs` with `n_tokens`, `ids` (decimal, one space between) and `decoded`, the ids' bytes.

    Null and empty texts have no tokens. Long texts and long words are encoded whole; equal texts
    get equal ids. Input columns named like an output are replaced, all others are passed on; an
    empty table gives an empty result.
    """
    outputs = [f.name for f in OUTPUTS]
    docs, names, (text,) = plain(docs, outputs, text)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
                n, ids, decoded = zip(*own.encode(texts), strict=True)
                extra = [pa.array(n, pa.int64()), pa.array([x.decode() for x in ids], pa.string()), pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *outputs])

    return docs.mapInArrow(encoded, T.StructType([*docs.schema.fields, *OUTPUTS])).toDF(*names, *outputs)
