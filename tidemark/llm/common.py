"""Helpers that several corpus operators share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ranks of rows without a document number: after all others.
LAST = (1 << 63) - 1
#: ASCII white space, the only characters that part words.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(docs: DataFrame, outputs: list[str], *columns: str) -> tuple[DataFrame, list[str], list[str]]:
    """`docs` under names that clash with nothing, its own names, and the new names of `columns`.

    Columns named like an output, in whatever case, are left out: the output replaces them.
    """
    taken = {c.lower() for c in outputs} - set(columns)
    names = [c for c in docs.columns if c.lower() not in taken]
    safe = {c: f"_c{i}" for i, c in enumerate(names)}
    return docs.select([col(c).alias(safe[c]) for c in names]), names, [safe[c] for c in columns]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, measured."""
    return docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0


def groups_for(total: int, each: int) -> int:
    """How many groups of about `each` hold `total`."""
    return max(1, math.ceil(total / each))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False


def places(size: int) -> np.ndarray:
    """`size` fixed odd 64-bit factors, one for each place of a sequence."""
    global _PLACE
    if size > len(_PLACE):
        count = 1 << (size - 1).bit_length()
        _PLACE = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return _PLACE


def sequence_hash(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run values[start : start + length]; no run is empty."""
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    items = values[np.repeat(starts, lengths) + within] * places(int(lengths.max()))[within]
    return mix(np.add.reduceat(items, ends - lengths) + lengths.astype(np.uint64))


def byte_values(data: bytes) -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return _BYTE[np.frombuffer(data, np.uint8)]


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hash, the first byte and the length of every word `[^\\x20\\x09-\\x0D]+` of `data`."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], _IS_WORD[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, lengths
    return sequence_hash(_BYTE[raw], starts, lengths), starts, lengths


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    return words_of(data)[:2]


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of every `size` neighbours, by doubling; values has that many at least."""
    base, have, out, done = np.uint64(0x9E3779B97F4A7C15), values, None, 0
    width, power = 1, base
    while True:
        if size & width:
            if out is None:
                out, done = have, width
            else:
                out = _joined(have, out, width, done, base)
                done += width
        width *= 2
        if width > size:
            return mix(out[: len(values) - size + 1])
        have = have[: len(have) - width // 2] * power + have[width // 2 :]
        power = np.uint64(int(power) ** 2 % (1 << 64))


def _joined(left: np.ndarray, right: np.ndarray, width: int, done: int, base: np.uint64) -> np.ndarray:
    size = min(len(left), len(right) - width)
    factor = np.uint64(pow(int(base), done, 1 << 64))
    return left[:size] * factor + right[width : width + size]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    size, out, have = len(values) - width + 1, values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:size], out[width - have : width - have + size])
