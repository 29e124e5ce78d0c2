"""Ranked lexical search: hashed max-sketches give bounds, documents are scored exactly by falling bound.

The impact of a term in a document grows with its occurrences there and falls with the document's
length. A document's impacts fold into `WIDTH` coordinates, the largest impact of each winning. An
item's terms look their coordinates up; the weighted sum bounds the document's score from above,
since other terms at a coordinate can only raise it. All items of a block are looked up at once, as
a product of matrices. Documents are then scored exactly by falling bound, until the bound drops
below the tenth best score that the task has seen. The tasks' winners are ranked against each other.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import LAST, col, groups_for
from .terms import LETTERS_DIGITS, cutter, texts_of

WIDTH = 8192
#: Items, and bytes of their texts, in one block; each block is one pass over the documents.
ITEMS, ITEM_BYTES = 1024, 1 << 20
#: Documents and text bytes of one matrix of sketches.
_DOCS, _TEXT = 512, 4 << 20
FOUND = "item long, item_id long, doc_id long, score long"


class Coordinates(dict):
    """The coordinate of each term met lately."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[term] = place = zlib.crc32(term) % WIDTH
        return place


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf, m):
    """The weight of `tf` occurrences in a document of length measure `m`."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_measure(n, n_docs: int, n_terms: int):
    return 100 - 90 + (90 * n * n_docs) // n_terms


def corpus_numbers(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and in how many documents each term of `vocabulary` is.

    Tasks count; what comes back is no longer than the vocabulary.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(LETTERS_DIGITS)
        holding, some, terms = Counter(), 0, 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                words = cut(text)
                some += bool(words)
                terms += len(words)
                holding.update(vocabulary.intersection(words))
        names, counts = [None, b"", *holding], [some, terms, *holding.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(counted, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {None if r.term is None else bytes(r.term): r.n for r in rows}
    return found.pop(None, 0), found.pop(b"", 0), found


class Search:
    """The best documents of each item among those given to it, in bounded memory."""

    def __init__(self, items: list[tuple[int, dict[bytes, int]]], n_docs: int, n_terms: int, top: int) -> None:
        self.items, self.n_docs, self.n_terms, self.top = items, n_docs, n_terms, top
        self.cut, self.coordinates = cutter(LETTERS_DIGITS), Coordinates()
        self.lookup = np.zeros((WIDTH, len(items)))
        for i, (_, weights) in enumerate(items):
            for term, w in weights.items():
                self.lookup[self.coordinates[term], i] += w
        self.best: list[list[tuple[int, int]]] = [[] for _ in items]
        self.least = np.ones(len(items))

    def add(self, numbers: list[int], texts: list[bytes]) -> None:
        counts, measures, rows, places, impacts = [], [], [], [], []
        for i, text in enumerate(texts):
            words = self.cut(text)
            tf = Counter(words)
            m = length_measure(len(words), self.n_docs, self.n_terms) if words else 1
            counts.append(tf)
            measures.append(m)
            rows.append(np.full(len(tf), i))
            places.append(np.fromiter(map(self.coordinates.__getitem__, tf), np.int64, len(tf)))
            impacts.append(impact(np.fromiter(tf.values(), np.int64, len(tf)), m))
        sketch = np.zeros((len(texts), WIDTH))
        np.maximum.at(sketch, (np.concatenate(rows), np.concatenate(places)), np.concatenate(impacts))
        bounds = sketch @ self.lookup * (1 + 1e-12)  # whole numbers, exact but for items with some 100,000 terms
        for item in np.flatnonzero((bounds >= self.least).any(axis=0)).tolist():
            bound = bounds[:, item]
            open_docs = np.flatnonzero(bound >= self.least[item])
            for doc in open_docs[np.argsort(-bound[open_docs], kind="stable")].tolist():
                if bound[doc] < self.least[item]:
                    break
                self._score(item, numbers[doc], counts[doc], measures[doc])

    def _score(self, item: int, number: int, tf: Counter, m: int) -> None:
        weights = self.items[item][1]
        score = sum(w * impact(tf[t], m) for t, w in weights.items() if t in tf)
        if score <= 0:
            return
        best, entry = self.best[item], (score, -number)
        if len(best) < self.top:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == self.top:
            self.least[item] = best[0][0]

    def rows(self) -> pa.RecordBatch:
        found = [(i, self.items[i][0], -number, score) for i, best in enumerate(self.best) for score, number in best]
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["item", "item_id", "doc_id", "score"])


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin == _DOCS or size + len(text) > _TEXT):
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _searched(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """The best documents of each task for one block of items."""
    vocabulary = {t for _, terms in items for t in terms}
    n_docs, n_terms, df = corpus_numbers(docs, vocabulary)
    weighted = [(number, {t: w for t in sorted(set(terms)) if (w := weight(n_docs, df[t]) if t in df else 0)}) for number, terms in items]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(weighted, n_docs, n_terms, top)
        for batch in batches:
            for piece in range(0, batch.num_rows, _DOCS):
                part = batch.slice(piece, _DOCS)
                numbers = [LAST if x is None else x for x in part.column(0).to_pylist()]
                texts = list(texts_of(part.column(1)))
                for a, b in _runs(texts):
                    search.add(numbers[a:b], texts[a:b])
        yield search.rows()

    return docs.mapInArrow(found, FOUND)


def lexical_search(docs: DataFrame, items: DataFrame, top: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_items: int = ITEMS, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the `top` documents of each item with a score above 0.

    Items are taken in blocks of about `block_items` and `block_bytes` of text, so what tasks and
    driver hold of them is bounded; documents are never moved, and a task sends `top` rows an item.
    Null and empty texts have no terms; very long ones are taken whole. Equal scores rank by document
    number, rows without one last (their `doc_id` is null); a repeated document is one more
    candidate. Items alike in number and text are searched once, others with a number in common (or
    none) each have their own ranks. Other columns are not looked at, whatever their names. Without
    documents or items there are no rows.
    """
    own = docs.select(col(doc).cast("long").alias("doc_id"), col(text).alias("text"))
    asked = items.select(col(item).cast("long").alias("item_id"), col(item_text).alias("text")).distinct()
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(groups_for(count, block_items), groups_for(size, block_bytes))
    cut, found = cutter(LETTERS_DIGITS), None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        some = _searched(own, [(r.item_id, cut((r.text or "").encode())) for r in rows], top).withColumn("block", F.lit(block))
        found = some if found is None else found.unionByName(some)
    order = W.partitionBy("block", "item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "score")


def search_sql(top: int = 10) -> str:
    """DuckDB SQL of the search over views `documents` and `benchmark`."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, unnest({terms}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM n, total),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {top}
"""
