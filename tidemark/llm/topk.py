"""Exact top-k by inner product: norm-bucketed retrieval.

Vectors are grouped by length into buckets, each cut into chunks of bounded size; queries into
blocks. A first pass over the longest vectors gives every query a score that its k-th best reaches
at least. Against a bucket that score becomes a cosine threshold: above 1 the bucket is skipped; a
high one prunes by coordinates (a vector within the angle can differ from the query's strongest
coordinates only so much), a low one by length. What remains is verified by the product itself, so
the result is exact whatever the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

from .common import col, groups_for

STEPS = 8  # buckets for each doubling of the length
FOCUS = 4  # coordinates that coordinate pruning looks at
HIGH = 0.8  # from this cosine threshold on, prune by coordinates
_EXACT = float(1 << 52)


def whole_vectors(table: DataFrame, scale: int = 1024, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, norm, v): floor(scale * x) of every component, as little-endian 64-bit integers.

    Rows without a number or a vector, or with a null or non-finite component, or one too large for
    64 bits, take no part.
    """

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, values in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if number is None or values is None or any(x is None for x in values):
                    continue
                x = np.floor(scale * np.array(values, np.float64))
                if np.isfinite(x).all() and (np.abs(x) < 2.0**62).all():
                    rows.append((number, len(x), float(np.sqrt((x * x).sum())), x.astype("<i8").tobytes()))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "norm", "v"])

    source = table.select(col(id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("v"))
    return source.mapInArrow(turned, "vec_id long, dim int, norm double, v binary")


def _matrix(rows: pa.Table) -> np.ndarray:
    data = b"".join(rows.column("v").to_pylist())
    return np.frombuffer(data, "<i8").reshape(rows.num_rows, -1)


def _products(queries: np.ndarray, vectors: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products: in doubles while every partial sum stays below 2**52."""
    if bound < _EXACT:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return np.array([[sum(a * b for a, b in zip(q, v, strict=True)) for v in vectors.tolist()] for q in queries.tolist()], dtype=object)


def _candidates(queries: np.ndarray, q_norm: np.ndarray, least: np.ndarray, vectors: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Which pairs the local thresholds let through; a pair left out scores below the query's `least`."""
    longest = norm.max(initial=0.0)
    slack = 1 + 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_norm * longest > 0, least / (q_norm * longest), np.where(least > 0, 2.0, -2.0))
        by_length = norm[None, :] * q_norm[:, None] * slack >= least[:, None]
    open_ = by_length | (least <= 0)[:, None]
    open_[cosine > slack] = False
    steep = np.flatnonzero((cosine >= HIGH) & (cosine <= slack))
    if len(steep) and longest > 0:
        unit = vectors / np.maximum(norm, 1e-300)[:, None]
        for i in steep:
            q, t = queries[i] / q_norm[i], min(1.0, cosine[i])
            for f in np.argsort(-np.abs(q))[:FOCUS]:
                reach = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] * q[f])))
                low, high = (-1.0 if q[f] < -t else t * q[f] - reach), (1.0 if q[f] > t else t * q[f] + reach)
                open_[i] &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
    return open_


def _best(rows: pa.Table, k: int) -> pa.Table:
    """The best k of one chunk for each query of one block."""
    is_query = rows.column("is_query").to_numpy(zero_copy_only=False)
    queries, vectors = rows.filter(pa.array(is_query)), rows.filter(pa.array(~is_query))
    out: list[tuple[int, int, int]] = []
    if queries.num_rows and vectors.num_rows:
        q, v = _matrix(queries), _matrix(vectors)
        q_id, v_id = queries.column("vec_id").to_numpy(), vectors.column("vec_id").to_numpy()
        q_norm, norm = queries.column("norm").to_numpy(), vectors.column("norm").to_numpy()
        least = queries.column("least").to_numpy()
        open_ = _candidates(q, q_norm, least, v, norm) & (q_id[:, None] != v_id[None, :])
        used = np.flatnonzero(open_.any(axis=0))
        if len(used):
            score = _products(q, v[used], float(q_norm.max() * norm.max()))
            for i in range(len(q)):
                at = np.flatnonzero(open_[i, used])
                if len(at) > k and score.dtype != object:
                    own = score[i, at]
                    at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
                ranked = sorted(zip((-score[i, at]).tolist(), v_id[used[at]].tolist(), strict=True))[:k]
                out += [(int(q_id[i]), -s, x) for s, x in ranked]
    return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[2] for x in out], pa.int64()), "score": pa.array([x[1] for x in out], pa.int64())})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _longest(parted: DataFrame, count: int, chunks: int) -> DataFrame:
    """The `count` longest of each dimension, first of each chunk, then of ever more chunks together: no task sorts them all."""
    while True:
        order = Window.partitionBy("dim", F.col("chunk") % chunks).orderBy(F.desc("norm"), "vec_id")
        parted = parted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count).drop("place")
        if chunks <= 1:
            return parted
        chunks = -(-chunks // 16)


def top_k(table: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block: int = 1024, chunk: int = 8192, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest integer products, ties to smaller numbers.

    Queries are the rows whose number `every` divides; candidates are all rows but those of the
    query's own number. Only vectors of equal dimension are compared. Rows that repeat a number are
    one candidate each and one query (equal results are given once). Fewer than k candidates: all.
    An empty table gives an empty result.
    """
    vectors = staged(whole_vectors(table, scale, id, vector), "vectors").dropDuplicates(["vec_id", "v"])
    size = vectors.count()
    blocks, chunks = groups_for(-(-size // every), block), groups_for(size, chunk)
    bucket = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * STEPS)).otherwise(-1)
    parted = vectors.withColumn("bucket", bucket.cast("int")).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    queries = vectors.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    keys = ["block", "dim", "bucket", "chunk"]

    def against(chosen: DataFrame, asked: DataFrame) -> DataFrame:
        """Every query block meets every chunk of `chosen` of its dimension once."""
        number = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        there = chosen.select("vec_id", "norm", "v", F.lit(0.0).alias("least"), F.lit(False).alias("is_query"), number.alias("block"), "dim", "bucket", "chunk")
        groups = chosen.select("dim", "bucket", "chunk").distinct()
        here = asked.join(groups, "dim").select("vec_id", "norm", "v", "least", F.lit(True).alias("is_query"), *keys)
        return there.union(here).groupBy(*keys).applyInArrow(lambda t: _best(t, k), "query_id long, vec_id long, score long")

    seeds = _longest(parted, chunk // 4, chunks).withColumn("bucket", F.lit(0)).withColumn("chunk", F.lit(0))
    first = _ranked(against(seeds, queries.withColumn("least", F.lit(-np.inf))), k).where(F.col("rank") == k)
    least = staged(first.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least")), "least")
    asked = queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(-np.inf)))
    return _ranked(against(parted, asked).distinct(), k).select("query_id", "rank", "vec_id", "score")
