"""Near-duplicate detection: b-bit MinHash signatures and banding, links confirmed on full sets.

1. One row a document: set size, a 128-bit set hash, band keys of `bands` x `rows` minima, and a
   signature that keeps the low `BITS` bits of every minimum, and the parities of its shingles in
   `PARITIES` bins. Documents with equal sets form a class; its smallest number stands for it.
2. A band key that two classes share makes a bucket. First every member is paired with the smallest
   of the bucket, so a group of any size costs one pair for each member. The signatures' bit counts
   estimate the similarity, corrected for chance agreement; pairs far below the threshold go. So do
   pairs whose parities differ in more bins than two sets that reach it can differ in shingles: each
   odd bin holds a shingle that only one of them has, so this bound is exact.
3. Remaining pairs are confirmed by the intersection of the full sets; links give components.
4. Members of one bucket that are still in different components are paired, estimated, confirmed
   and joined likewise. A bucket inside one component needs no more pairs, so nothing is capped.

Tables between the steps are written to the session's shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import staged

from .common import col, mix, plain, rolling, word_hashes

BITS = 2
PARITIES = 1024
_CHUNK = 1 << 18
_FULL = 0x5555555555555555


def _hash_params(count: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    high = (seed >> np.uint64(32)).astype(np.uint32)
    return high[:count] | np.uint32(1), high[count:]


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; with fewer words the whole sequence is one."""
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= _CHUNK:
            size += len(texts[end])
            end += 1
        some = texts[begin:end]
        hashes, at = word_hashes(b"\n".join(some).lower())
        bounds = np.searchsorted(at, np.concatenate(([0], np.cumsum([len(x) + 1 for x in some]))))
        grams = rolling(hashes, shingle) if len(hashes) >= shingle else np.zeros(0, np.uint64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= shingle:
                yield np.unique(grams[a : b - shingle + 1])
            elif b > a:
                yield rolling(hashes[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
        begin = end


def minima(values: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The least value of a set under every hash function."""
    low = (values >> np.uint64(32)).astype(np.uint32)[:, None]
    out = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        np.minimum(out, (low[at : at + 256] * factor + shift).min(axis=0), out=out)
    return out


def packed(minimum: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 64 // BITS to a word."""
    each = 64 // BITS
    low = np.zeros(-(-len(minimum) // each) * each, np.uint64)
    low[: len(minimum)] = minimum & np.uint32((1 << BITS) - 1)
    shifts = np.arange(each, dtype=np.uint64) * np.uint64(BITS)
    return (low.reshape(-1, each) << shifts).sum(axis=1, dtype=np.uint64)


def _bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]


def _bit_columns(words: int) -> list[str]:
    return [f"s{i}" for i in range(words)] + [f"p{i}" for i in range(PARITIES // 64)]


def _marks(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc, n, h1, h2 (set hash), band keys, signature and parity words."""
    words = -(-bands * rows * BITS // 64)
    names = ["n", "h1", "h2", "keys", *_bit_columns(words)]
    parity_bits = np.uint64(64 - (PARITIES - 1).bit_length())

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _hash_params(bands * rows)
        powers = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(7))
        for batch in batches:
            count = batch.num_rows
            n, h = np.zeros(count, np.int64), np.zeros((2, count), np.uint64)
            keys, signature = np.zeros((count, bands), np.uint64), np.zeros((count, words + PARITIES // 64), np.uint64)
            for i, values in enumerate(shingle_sets(_bytes(batch, "text"), shingle)):
                n[i] = len(values)
                if not len(values):
                    continue
                h[0, i], h[1, i] = mix(values).sum(), np.bitwise_xor.reduce(mix(values * np.uint64(0x9E3779B97F4A7C15)))
                least = minima(values, factor, shift)
                keys[i] = mix((least.reshape(bands, rows) * powers).sum(axis=1, dtype=np.uint64) + salt)
                signature[i, :words] = packed(least)
                odd = np.bincount((values >> parity_bits).astype(np.int64), minlength=PARITIES) & 1
                signature[i, words:] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            columns = [pa.array(n), *(pa.array(x.view(np.int64)) for x in h), lists, *(pa.array(np.ascontiguousarray(signature[:, j]).view(np.int64)) for j in range(signature.shape[1]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc", *names])

    kinds = ["long"] * 3 + ["array<long>"] + ["long"] * (len(names) - 4)
    return docs.mapInArrow(marked, "doc long, " + ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))


def _estimate(words: int, slots: int) -> Column:
    """Similarity of two signatures a and b: agreeing slots, less those that agree by chance."""
    differ = F.lit(0)
    for i in range(words):
        x = F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(_FULL)))
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(slots)) - chance) / (1 - chance)


def _plausible(words: int, slots: int, percent: int) -> Column:
    """Sizes and parities that allow the threshold, and an estimate at most six standard errors below it."""
    threshold = percent / 100
    apart = F.lit(0)
    for i in range(PARITIES // 64):
        apart = apart + F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}")))
    chance = 1 / (1 << BITS)
    agree = chance + (1 - chance) * threshold
    slack = 6 * (agree * (1 - agree) / slots) ** 0.5 / (1 - chance)
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    close = (100 + percent) * apart <= (100 - percent) * (F.col("a.n") + F.col("b.n"))
    return (100 * small >= percent * large) & close & (_estimate(words, slots) >= threshold - slack)


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. `links` (a, b) joins nodes; rounds end at a fixpoint.

    Each round every node takes the least label among its neighbours, then its label's label.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        stepped = lower.join(jump, F.col("next") == F.col("at"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) != F.col("component")).alias("moved"))
        done = staged(stepped, "labels")
        labels = done.select("node", "component")
        if done.where("moved").isEmpty():
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * both >= percent * either."""
    joined = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id, kept): one row for each row of `docs`.

    Texts are linked if 100 * intersection >= percent * union of their shingle sets (A-Z lower-cased;
    shingles compared by 64-bit hashes). Null texts and texts without words have no set and are
    linked with nothing. Rows that repeat a number count as that number: it has the links of all of
    them. Rows without a number are linked with nothing: component_id is null and kept true. Long
    texts are read whole. An empty table gives an empty result.
    """
    slots = bands * rows
    words = -(-slots * BITS // 64)
    source = docs.select(col(id).cast("long").alias("doc"), col(text).alias("text"))
    marks = staged(_marks(source, shingle, bands, rows), "marks")
    known = marks.where("doc IS NOT NULL AND n > 0")
    classes = known.groupBy("n", "h1", "h2").agg(F.min("doc").alias("node"))
    members = staged(known.join(classes, ["n", "h1", "h2"]).select("doc", "node", "n", "h1", "h2", "keys", *_bit_columns(words)), "members")
    heads = members.where("doc = node").dropDuplicates(["node", "n", "h1", "h2"])
    nodes = heads.select("node", "n", *_bit_columns(words))
    spread = heads.select("node", F.explode("keys").alias("key"))
    buckets = staged(spread.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least"), "buckets")
    placed = staged(spread.join(buckets, "key").select("key", "node", "least").distinct(), "placed")

    touched = placed.select(F.col("node").alias("doc")).distinct()
    wanted = source.join(touched, "doc", "left_semi")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(_bytes(batch, "text"), shingle))
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            flat = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))], names=["doc", "shingles"])

    sets = staged(wanted.mapInArrow(listed, "doc long, shingles array<long>"), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = nodes.alias("a"), nodes.alias("b")
        both = pairs.join(a, F.col("x") == F.col("a.node")).join(b, F.col("y") == F.col("b.node")).where(_plausible(words, slots, percent))
        return _confirmed(both.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), sets, percent)

    # numbers that head two classes, or whose rows lie in several, tie these together
    several = members.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("doc", "a")
    joint = members.join(several, "doc").select("a", F.col("node").alias("b")).where("a < b")
    stars = placed.where("node > least").select(F.col("least").alias("x"), F.col("node").alias("y")).distinct()
    first = staged(linked(stars).union(joint), "links")
    labels = _components(touched.select(F.col("doc").alias("node")).union(joint.select("a")).union(joint.select("b")).distinct(), first)

    inside = placed.join(labels, "node")
    split = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    open_ = staged(inside.join(split, "key").join(nodes, "node").select("key", "node", "component", "n", *_bit_columns(words)), "open")
    a, b = open_.alias("a"), open_.alias("b")
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & _plausible(words, slots, percent))
    second = staged(_confirmed(across.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), sets, percent), "links")
    if not second.isEmpty():
        labels = _components(labels.select("node"), first.union(second))

    by_class = members.select("doc", "node", "n", "h1", "h2")
    placed_docs = by_class.join(labels, "node", "left").select("doc", "n", "h1", "h2", F.coalesce("component", "node").alias("component_id"))
    single = marks.where("doc IS NULL OR n = 0").select("doc", "n", F.when(F.col("n") == 0, F.col("doc")).alias("component_id"))
    out = placed_docs.select("doc", "n", "component_id").union(single)
    return out.select("doc", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, id: str = "doc_id", **settings: object) -> DataFrame:
    """`docs` without the rows whose number is not the least of its component; equal rows of a kept number stay.

    All columns are passed on under their names.
    """
    found = near_duplicates(docs, id=id, **settings)
    dropped = found.where("NOT kept").select("doc").distinct()
    plain_docs, names, (number,) = plain(docs, [], id)
    return plain_docs.join(dropped, plain_docs[number].cast("long") == dropped["doc"], "left_anti").toDF(*names)
