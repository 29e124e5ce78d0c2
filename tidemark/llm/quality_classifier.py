"""Ordinal quality classifier: a cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score); the score adds one shared weight for every distinct
hashed token of the text, the thresholds are ordered. Tokens are the lower-cased words, their first
bytes, the shapes of word ends (letters, digits and signs told apart) and a few style marks (shares
of capitals, symbols and distinct words, in steps). The fit uses a bounded sample of the rated
documents, in one task, and only tokens whose share differs clearly between grades; the fewer
standard errors it differs by, the smaller a weight's steps and the more it is shrunk. A larger
sample of the same shares leaves no token out that a smaller one takes. Scoring is a map over all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_values, col, mix, plain, sequence_hash, words_of
from .quality_rules import SYMBOLS, UPPER

GRADES = 3
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 0x80 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
HEADS, TAIL = (4, 6), 4  # bytes of a word's beginnings and of its shape's end
_CHUNK = 1 << 18


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 12_000  # rated documents that a fit reads at most
    buckets: int = 1 << 20
    clear: float = 4.5  # standard errors, at least, between a token's share in a grade and overall; other tokens keep weight 0
    rounds: int = 1500
    rate: float = 0.5
    shrink: float = 1e-5  # penalty of the square of a weight over its token's standard errors, as a share of the most met


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one for each bucket
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def _style(text: bytes, words: int, distinct: int) -> list[bytes]:
    size = max(1, len(text))
    share = lambda part, whole, steps: min(steps, int(steps * part / max(1, whole)))
    return [
        b"upper=%d" % share(size - len(text.translate(None, UPPER)), size, 10),
        b"symbols=%d" % share(size - len(text.translate(None, SYMBOLS + b"!?")), size, 20),
        b"distinct=%d" % share(distinct, words, 10),
        b"words=%d" % min(8, words.bit_length()),
    ]


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every text, all in one array, and the text of each."""
    found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= _CHUNK:
            size += len(texts[end])
            end += 1
        some = texts[begin:end]
        data = b"\n".join(some)
        bounds = np.cumsum([len(x) + 1 for x in some])
        lowered = data.translate(_PLAIN)
        hashes, at, size_of = words_of(lowered)
        owner = np.searchsorted(bounds, at, side="right")
        words = np.bincount(owner, minlength=len(some))
        whole = owner.astype(np.int64) * buckets + (hashes % np.uint64(buckets)).astype(np.int64)
        distinct = np.bincount(np.unique(whole) // buckets, minlength=len(some))
        parts = [whole]
        for size in HEADS if len(at) else ():
            head = mix(sequence_hash(byte_values(lowered), at, np.minimum(size_of, size)) + np.uint64(size))
            parts.append(owner * buckets + (head % np.uint64(buckets)).astype(np.int64))
        _, at, size_of = words_of(data)
        if len(at):
            last = np.minimum(size_of, TAIL)
            tail = mix(sequence_hash(byte_values(data.translate(_SHAPE)), at + size_of - last, last))
            parts.append(np.searchsorted(bounds, at, side="right") * buckets + (tail % np.uint64(buckets)).astype(np.int64))
        marks = [m for x, w, d in zip(some, words.tolist(), distinct.tolist(), strict=True) for m in _style(x, w, d)]
        lengths = np.array([len(m) for m in marks])
        mark = sequence_hash(byte_values(b"".join(marks)), np.cumsum(lengths) - lengths, lengths)
        marked = np.repeat(np.arange(len(some)), len(marks) // len(some)) * buckets + (mark % np.uint64(buckets)).astype(np.int64)
        pair = np.unique(np.concatenate((*parts, marked)))
        found.append(pair % buckets)
        owners.append(pair // buckets + begin)
        begin = end
    return np.concatenate(found), np.concatenate(owners)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    index, owner = features(texts, len(weights))
    return np.bincount(owner, weights=weights[index], minlength=len(texts))


def _grouped(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values in the order of their groups, where each group starts, and the groups met."""
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    return values[order], starts, of[order][starts]


def _twins(index: np.ndarray, owner: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The first token that stands in the same texts as each token, and how many do; their weights never differ."""
    order = np.argsort(index, kind="stable")
    starts = np.flatnonzero(np.diff(index[order], prepend=-1))  # every token is met
    texts = mix(owner.astype(np.uint64) + np.uint64(1))[order]
    _, first, group, members = np.unique(np.add.reduceat(texts, starts), return_index=True, return_inverse=True, return_counts=True) if tokens else (np.zeros(0, np.int64),) * 4
    return first[group], members[group]


def fit_arrays(index: np.ndarray, owner: np.ndarray, grade: np.ndarray, settings: Settings) -> Model:
    """Full-batch adaptive gradient steps; thresholds stay ordered as a start and positive gaps."""
    count = max(1, len(grade))
    of_grade = np.bincount(grade, minlength=GRADES)
    met = np.stack([np.bincount(index[grade[owner] == k], minlength=settings.buckets) for k in range(GRADES)])
    share = met.sum(axis=0) / count
    spread = share * (1 - share) * (of_grade * (1 - of_grade / count))[:, None]
    away = (np.abs(met - share * of_grade[:, None]) / np.sqrt(np.where(spread > 0, spread, np.inf))).max(axis=0)
    tokens, known = np.flatnonzero(away >= settings.clear), (away >= settings.clear)[index]
    scale = away[tokens] / away[tokens].max(initial=1.0)
    index, owner = np.searchsorted(tokens, index[known]), owner[known]
    twin, many = _twins(index, owner, len(tokens))
    kinds = np.unique(twin)
    of_kind = np.searchsorted(kinds, twin)
    first = twin[index] == index
    index, owner, scale, many = of_kind[index[first]], owner[first], scale[kinds], many[kinds]
    at_most = np.cumsum(np.bincount(grade, minlength=GRADES)) / count
    cut = np.clip(at_most[:-1], 1e-3, 1 - 1e-3)
    thresholds = np.log(cut / (1 - cut)) + 1e-3 * np.arange(GRADES - 1)
    gaps = np.log(np.maximum(np.diff(thresholds), 1e-3))
    base, weights = thresholds[0], np.zeros(len(kinds))
    memory, base_memory, gap_memory = np.full(len(kinds), 1e-8), 1e-8, np.full(len(gaps), 1e-8)
    of_text, text_starts, texts = _grouped(owner, index)
    of_token, token_starts, _ = _grouped(index, owner)  # every token is met
    score, taken = np.zeros(len(grade)), np.empty(len(index))  # one buffer for all rounds
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(settings.rounds):
        thresholds = base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        score[texts] = np.add.reduceat(np.take(many * weights, of_text, out=taken, mode="clip"), text_starts) if len(texts) else 0.0
        upper = np.where(grade < GRADES - 1, logistic(thresholds[np.minimum(grade, GRADES - 2)] - score), 1.0)
        lower = np.where(grade > 0, logistic(thresholds[np.maximum(grade, 1) - 1] - score), 0.0)
        mass = np.maximum(upper - lower, 1e-9)
        by_upper, by_lower = upper * (1 - upper) / mass / count, lower * (1 - lower) / mass / count
        push = by_upper - by_lower  # of the loss by the score
        slope = scale * (np.add.reduceat(np.take(push, of_token, out=taken, mode="clip"), token_starts) if len(kinds) else 0.0) + settings.shrink * weights / scale
        at = np.bincount(np.minimum(grade, GRADES - 2), weights=np.where(grade < GRADES - 1, -by_upper, 0), minlength=GRADES - 1)
        at += np.bincount(np.maximum(grade, 1) - 1, weights=np.where(grade > 0, by_lower, 0), minlength=GRADES - 1)
        gap_slope = np.cumsum(at[::-1])[::-1][1:] * np.exp(gaps)
        memory += slope**2
        base_memory += at.sum() ** 2
        gap_memory += gap_slope**2
        weights -= settings.rate * scale * slope / np.sqrt(memory)
        base -= settings.rate * at.sum() / np.sqrt(base_memory)
        gaps = gaps - settings.rate * gap_slope / np.sqrt(gap_memory)
    every = np.zeros(settings.buckets, np.float32)
    every[tokens] = weights[of_kind]
    return Model(every, base + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def _bytes(batch, text: str) -> list[bytes]:
    return [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]


def fit(docs: DataFrame, ratings: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text") -> Model:
    """Fits on at most `sample_rows` rated documents, chosen by a hash of the number.

    `ratings` has the document number and `grade` (0, 1 or 2); null grades or numbers take no part.
    Without a rating every weight is 0. The sample is broadcast: its size is a parameter.
    """
    graded = ratings.select(col(id).cast("long").alias("_id"), F.col("grade").cast("int").alias("_grade")).where("_id IS NOT NULL AND _grade BETWEEN 0 AND 2")
    sample = graded.orderBy(F.xxhash64("_id"), "_id", "_grade").limit(settings.sample_rows)
    rated = docs.select(col(id).cast("long").alias("_id"), col(text).alias("_text")).join(F.broadcast(sample), "_id")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, owner = features(_bytes(batch, "_text"), settings.buckets)
            bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))))
            order = np.argsort(owner, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(index[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_grade"), lists], names=["_id", "_grade", "_tokens"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            model = Model(np.zeros(settings.buckets, np.float32), np.arange(GRADES - 1, dtype=float))
        else:
            whole = pa.Table.from_batches(rows).sort_by([("_id", "ascending"), ("_grade", "ascending")]).combine_chunks()
            tokens = whole.column("_tokens").chunk(0)
            index, sizes = tokens.flatten().to_numpy().astype(np.int64), np.diff(tokens.offsets.to_numpy())
            model = fit_arrays(index, np.repeat(np.arange(len(sizes)), sizes), whole.column("_grade").to_numpy().astype(np.int64), settings)
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (used, model.weights[used], model.thresholds)], names=["used", "weights", "thresholds"])

    lists = rated.mapInArrow(gathered, "_id long, _grade int, _tokens array<int>")
    row = lists.repartition(1).mapInArrow(fitted, "used binary, weights binary, thresholds binary").first()
    weights = np.zeros(settings.buckets, np.float32)
    weights[np.frombuffer(row.used, np.int64)] = np.frombuffer(row.weights, np.float32)
    return Model(weights, np.frombuffer(row.thresholds, np.float64))


def graded(labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """Grades from `quality` and `toxic`: 0 poor, 1 good but toxic, 2 good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(col(id), grade.alias("grade"))


OUTPUTS = [T.StructField("expected_grade", T.DoubleType()), T.StructField("p_clean", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def classify(docs: DataFrame, model: Model, least: float = 0.8, text: str = "text") -> DataFrame:
    """The rows of `docs` with `expected_grade`, `p_clean` (that of the highest grade) and `kept` (p_clean >= least).

    Null and empty texts are scored by their style marks alone. Equal texts get equal scores, long
    texts are read whole. Input columns named like an output are replaced, all others passed on;
    an empty table gives an empty result.
    """
    outputs = [f.name for f in OUTPUTS]
    docs, names, (text,) = plain(docs, outputs, text)
    used, buckets = np.flatnonzero(model.weights), len(model.weights)
    few, thresholds = model.weights[used], model.thresholds  # tasks get the weights in use

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(buckets, np.float32)
        weights[used] = few
        own = Model(weights, thresholds)
        for batch in batches:
            tails = own.tails(scores(_bytes(batch, text), weights))
            kept = tails[:, -1] >= least
            extra = [pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *outputs])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, *OUTPUTS])).toDF(*names, *outputs)
