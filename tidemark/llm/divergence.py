"""Source divergence audit: the terms and the other sources that set a source apart within its language.

Terms are counted in the tasks, then by (language, source, term). The terms that set a source apart are found
without ranking its whole vocabulary: a term comes before every term that it dominates (at least the
group count, at most the language count, earlier in UTF-8), whatever the totals are. Every partition
keeps the terms dominated by fewer than `top` others, these skybands are merged, and only what is
left is ranked by the exact frequencies.

The distance of two sources sums over the whole vocabulary. It is taken in blocks of terms and
sources: terms that neither source has add one fixed difference each, all others stand in a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.session import staged
from .common import col
from .terms import LETTERS, cutter, texts_of

#: The same terms in SQL: letters of ASCII and everything beyond it.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, ADDED = 1_000_000_000, 5
#: Bytes of a term that decide whether it is earlier; terms alike in these don't dominate each other.
_PREFIX = 64
_STEP = 256
#: Terms and sources of one block of distances, and the parts in which a group's skybands first meet.
_TERMS, _SOURCES, _SALTS = 4096, 256, 16
#: Terms a task counts before it gives them out.
_HELD = 600_000

BAND = "lang string, source string, term string, c long, lang_c long"
OUTPUT = "lang string, source string, part string, item string, value long, rank int"


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exact; null without kept terms."""
    up = (count + ADDED).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    down = F.nullif((total + ADDED * kept).cast("decimal(19,0)"), F.lit(0).cast("decimal(19,0)"))
    return F.call_function("div", up, down) + 1


class Skyband:
    """The points of one group that fewer than `most` others dominate, met in dominance order."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.low, self.name = np.zeros(0, np.int64), np.zeros(0, f"S{_PREFIX}")

    def add(self, low: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Which of the next points stay; points come by count down, language count up, UTF-8 up.

        What dominates a dropped point also dominates whatever that point dominates, and `most` of
        these were kept. So it is enough to count the kept ones.
        """
        place = np.unique(np.concatenate((self.name, name)), return_inverse=True)[1]
        own = place[len(self.name) :]
        held_low, held_place = self.low, place[: len(self.name)]
        stay = np.zeros(len(low), bool)
        for at in range(0, len(low), _STEP):
            part = slice(at, at + _STEP)
            x, y = low[part], own[part]
            count = np.count_nonzero((held_low <= x[:, None]) & (held_place < y[:, None]), axis=1)
            count += np.count_nonzero(np.tril((x <= x[:, None]) & (y < y[:, None]), -1), axis=1)
            stay[part] = keep = count < self.most
            held_low, held_place = np.append(held_low, x[keep]), np.append(held_place, y[keep])
        self.low, self.name = held_low, np.append(self.name, name[stay])
        return stay


def skybands(counts: DataFrame, most: int) -> DataFrame:
    """The rows of each (lang, source) that fewer than `most` rows of it in the same partition dominate.

    Rows are sorted by Spark and streamed; a task holds one batch and the skyband of one group.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band = None, Skyband(most)
        for batch in batches:
            low = batch.column("lang_c").to_numpy()
            name = np.array([t.encode()[:_PREFIX] for t in batch.column("term").to_pylist()], f"S{_PREFIX}")
            stay, at = np.zeros(len(low), bool), 0
            for key, rows in groupby(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                if key != group:
                    group, band = key, Skyband(most)
                part = slice(at, at + sum(1 for _ in rows))
                stay[part] = band.add(low[part], name[part])
                at = part.stop
            yield batch.filter(pa.array(stay))

    names = [f.name for f in T._parse_datatype_string(BAND)]
    return counts.select(names).sortWithinPartitions("lang", "source", F.col("c").desc(), "lang_c", "term").mapInArrow(kept, BAND)


def merged(bands: DataFrame, most: int) -> DataFrame:
    """The skyband of each whole group: first `_SALTS` parts of it, then what these leave."""
    salt = F.pmod(F.xxhash64("term"), F.lit(_SALTS))
    return skybands(skybands(bands.repartition("lang", "source", salt), most).repartition("lang", "source"), most)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, given out whenever `_HELD` terms are at hand."""
    cut = cutter(LETTERS)
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        terms = [t for c, _ in found.values() for t in c]
        of_group = np.repeat(np.arange(len(found)), [len(c) for c, _ in found.values()])
        langs, sources = (pa.array([k[i] for k in found], pa.string()).take(pa.array(of_group)) for i in (0, 1))
        c, docs = [n for c, _ in found.values() for n in c.values()], [d[t] for c, d in found.values() for t in c]
        return pa.RecordBatch.from_arrays([langs, sources, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "c", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_of(batch.column("text")), strict=True):
            words = cut(text)
            c, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(c)
            c.update(words)
            docs.update(set(words))
            held += len(c)
            if held > _HELD:
                yield out()
                found, held = {}, 0
    if held:
        yield out()


def term_counts(docs: DataFrame, least: int, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Occurrences `c` of every kept term by (lang, source), beside the language's `lang_c`.

    A task gives out what it has counted, so a hot source sends one row a term and task. `head`
    marks one row of each (lang, term).
    """
    base = docs.select(F.coalesce(col(lang), F.lit("")).alias("lang"), F.coalesce(col(source), F.lit("")).alias("source"), col(text).alias("text"))
    parts = base.mapInArrow(_counted, "lang string, source string, term string, c long, docs long")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    same = W.partitionBy("lang", "term")
    whole = counts.select("*", F.sum("c").over(same).alias("lang_c"), F.sum("docs").over(same).alias("lang_docs"), (F.row_number().over(same.orderBy("source")) == 1).alias("head"))
    return whole.where(F.col("lang_docs") >= least).select("lang", "source", "term", "c", "lang_c", "head")


def groups(docs: DataFrame, counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every (lang, source) that occurs: `n` and `lang_n` occurrences of kept terms, `v` kept terms of the language."""
    every = docs.select(F.coalesce(col(lang), F.lit("")).alias("lang"), F.coalesce(col(source), F.lit("")).alias("source")).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = counts.groupBy("lang").agg(F.sum("c").alias("lang_n"), F.count_if("head").alias("v"))
    return every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "lang_n", "v"])


def leading_terms(counts: DataFrame, every: DataFrame, top: int) -> DataFrame:
    """The `top` terms of each group whose share exceeds the language's most, from the merged skybands."""
    band = merged(skybands(counts, top), top)
    p, q = share(F.col("c"), F.col("n"), F.col("v")), share(F.col("lang_c"), F.col("lang_n"), F.col("v"))
    above = band.join(every, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Distances of the sources in `right` over the terms of one block.

    A term absent from the block adds the fixed difference; block 0 adds it for every kept term, and
    each block puts its own terms right.
    """
    right = right.sort_by("source_no")
    number = right.column("source_no").to_numpy()
    base = right.column("base").to_numpy()
    text = left.column("term").combine_chunks().dictionary_encode()
    share_of = np.repeat(base[:, None], len(text.dictionary), axis=1)
    share_of[np.searchsorted(number, left.column("source_no").to_numpy()), text.indices.to_numpy()] = left.column("p").to_numpy()
    key = right.slice(0, 1).select(["lang", "low", "high", "term_block"]).to_pylist()[0]
    times = (right.column("v")[0].as_py() if key["term_block"] == 0 else 0) - len(text.dictionary)
    block = number // _SOURCES
    lows, highs = np.flatnonzero(block == key["low"]), np.flatnonzero(block == key["high"])
    parts = []
    for a in lows.tolist():
        apart = np.abs(share_of[highs] - share_of[a]).sum(axis=1) + times * np.abs(base[highs] - base[a])
        others = highs != a
        parts.append((np.full(others.sum(), a), highs[others], apart[others]))
    a, b, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    if key["low"] != key["high"]:
        a, b, value = np.append(a, b), np.append(b, a), np.append(value, value)
    names = right.column("source")
    return pa.table({"lang": pa.array([key["lang"]] * len(a), pa.string()), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": value})


def source_distances(counts: DataFrame, every: DataFrame) -> DataFrame:
    """The summed difference of shares for each two sources of a language, ranked by source."""
    numbered = every.select("lang", "source", "n", "v", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("source_no"))
    sizes = numbered.select("*", F.max("source_no").over(W.partitionBy("lang")).alias("last"))
    blocks = F.ceil(F.greatest(F.col("v"), F.lit(1)) / _TERMS).cast("int")
    here, other = F.floor(F.col("source_no") / _SOURCES).cast("int"), F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / _SOURCES).cast("int"))).alias("other")
    ends = [F.least(here, F.col("other")).alias("low"), F.greatest(here, F.col("other")).alias("high")]
    named = sizes.select("*", other).select("lang", "source", "n", F.col("v").cast("long").alias("v"), "source_no", *ends, blocks.alias("blocks"))
    base = F.coalesce(share(F.lit(0), F.col("n"), F.col("v")), F.lit(0)).cast("long").alias("base")
    right = named.select("lang", "source", "v", "source_no", "low", "high", base, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("term_block"))
    left = counts.join(named, ["lang", "source"]).select(
        "lang", "term", "source_no", "low", "high", share(F.col("c"), F.col("n"), F.col("v")).cast("long").alias("p"), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("term_block")
    )
    key = ["lang", "low", "high", "term_block"]
    left = left.toDF(*left.columns)  # columns of its own, apart from those it shares with the other side
    summed = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block, "lang string, source string, item string, value long")
    whole = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return whole.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank, for every (lang, source) of `docs`.

    A language keeps the terms that `least` of its documents hold. Null texts, languages and sources
    count as empty ones; an empty or very long text is taken whole. Groups without kept terms have
    pairs but no terms; without any kept term in the language, distances are 0. Equal values rank by
    UTF-8 bytes. A repeated row counts as often as it is there. Other columns of `docs` are not
    looked at, whatever their names; an empty table gives no rows.
    """
    counts = staged(term_counts(docs, least, lang, source, text), "terms")
    every = staged(groups(docs, counts, lang, source), "groups")
    return source_distances(counts, every).unionByName(leading_terms(counts, every, top))


def divergence_sql(least: int = 30, top: int = 50) -> str:
    """DuckDB SQL of the whole audit over a view `documents`."""
    p, q = (f"1 + ({SCALE}::HUGEINT * ({c} + {ADDED})) // ({n} + {ADDED} * v)" for c, n in (("coalesce(c, 0)", "n"), ("lang_c", "lang_n")))
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words FROM documents),
w AS (SELECT doc_id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_c FROM w GROUP BY ALL HAVING count(DISTINCT doc_id) >= {least}),
counts AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, sum(lang_c)::BIGINT AS lang_n, count(*) AS v FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(c)::BIGINT AS n FROM counts GROUP BY ALL),
every AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(lang_n, 0) AS lang_n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN own USING (lang, source) LEFT JOIN langs USING (lang)),
f AS (SELECT lang, source, term, c, {p} AS p, {q} AS q FROM every JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM f WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
