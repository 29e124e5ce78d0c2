"""Quality rules as a short-circuit cascade.

Each rule looks at a few measures of a text. On a sample the cost of a rule (seconds a text) and its
selectivity (share rejected) are estimated; rules then run in order of rejections per second, each
only on texts that every rule before it let pass. The verdict is the same in any order, so the
measured times change the work and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, mix, plain, rolling, word_hashes

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a UTF-8 character
_CHUNK = 1 << 18

Measure = Callable[[list[bytes]], np.ndarray]


def _words(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes and their text, over bounded runs of texts: (first text, end, hashes, owner in the run)."""
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= _CHUNK:
            size += len(texts[end])
            end += 1
        some = texts[begin:end]
        hashes, at = word_hashes(b"\n".join(some))
        bounds = np.cumsum([len(x) + 1 for x in some]) - 1
        yield begin, end, hashes, np.searchsorted(bounds, at, side="right")
        begin = end


def n_words(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64)] + [np.bincount(owner, minlength=end - begin) for begin, end, _, owner in _words(texts)])


def word_chars(texts: list[bytes]) -> np.ndarray:
    return np.array([len(x.translate(None, BLANKS + _LATER_BYTES)) for x in texts], np.int64)


def n_symbols(texts: list[bytes]) -> np.ndarray:
    return np.array([len(x) - len(x.translate(None, SYMBOLS)) for x in texts], np.int64)


def n_upper(texts: list[bytes]) -> np.ndarray:
    return np.array([len(x) - len(x.translate(None, UPPER)) for x in texts], np.int64)


def _lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip(BLANKS)]


def n_lines(texts: list[bytes]) -> np.ndarray:
    return np.array([len(_lines(x)) for x in texts], np.int64)


def n_dup_lines(texts: list[bytes]) -> np.ndarray:
    return np.array([len(x) - len(set(x)) for x in map(_lines, texts)], np.int64)


def n_repeat_words(texts: list[bytes]) -> np.ndarray:
    """Words inside three-word windows that the text holds twice or more, by 64-bit hashes."""
    out = [np.zeros(0, np.int64)]
    for begin, end, hashes, owner in _words(texts):
        count = np.zeros(end - begin, np.int64)
        if len(hashes) >= 3:
            key = rolling(hashes, 3) ^ mix(owner[:-2].astype(np.uint64))
            whole = np.flatnonzero(owner[:-2] == owner[2:])
            order = whole[np.argsort(key[whole])]
            same = key[order[1:]] == key[order[:-1]]
            repeated = np.zeros(len(hashes) + 2, bool)
            repeated[order[1:][same] + 2] = repeated[order[:-1][same] + 2] = True
            covered = repeated[2:] | repeated[1:-1] | repeated[:-2]
            count = np.bincount(owner[covered], minlength=end - begin)
        out.append(count)
    return np.concatenate(out)


MEASURES: dict[str, Measure] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """Rejects a text by whole-number measures; `sql` says the same over columns of those names."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., np.ndarray]
    sql: str


BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 50, "n_words < 50"),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n, "100 * n_repeat_words > 50 * n_words"),
)
DEFAULT = (
    *BASE,
    Rule("symbols", ("n_symbols", "word_chars"), lambda s, c: 100 * s > 10 * c, "100 * n_symbols > 10 * word_chars"),
    Rule("shouting", ("n_upper", "word_chars"), lambda u, c: 100 * u > 40 * c, "100 * n_upper > 40 * word_chars"),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda d, n: 100 * d > 30 * n, "100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 15 * n), "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)


class _Lazy:
    """Measures of some texts, each computed once and only for the texts asked for."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.values, self.known = texts, {}, {}

    def get(self, name: str, which: np.ndarray) -> np.ndarray:
        if name not in self.values:
            self.values[name], self.known[name] = np.zeros(len(self.texts), np.int64), np.zeros(len(self.texts), bool)
        open_ = which[~self.known[name][which]]
        if len(open_):
            self.values[name][open_] = MEASURES[name]([self.texts[i] for i in open_])
            self.known[name][open_] = True
        return self.values[name][which]


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT, text: str = "text", fraction: float = 0.01, seed: int = 17) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected), best rejections per second first.

    Every rule runs on its own over a random `fraction` of the rows; only sums leave the tasks.
    """

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r.name: [0.0, 0, 0] for r in rules}
        for batch in batches:
            texts = _texts(batch, "text")
            every = np.arange(len(texts))
            for rule in rules:
                began, lazy = time.perf_counter(), _Lazy(texts)
                rejected = int(np.count_nonzero(rule.rejects(*(lazy.get(m, every) for m in rule.measures))))
                sums[rule.name][0] += time.perf_counter() - began
                sums[rule.name][1] += len(texts)
                sums[rule.name][2] += rejected
        yield pa.RecordBatch.from_pylist([{"rule": k, "s": v[0], "n": v[1], "rejected": v[2]} for k, v in sums.items()], pa.schema([("rule", pa.string()), ("s", pa.float64()), ("n", pa.int64()), ("rejected", pa.int64())]))

    sample = docs.select(F.col(f"`{text}`").alias("text")).sample(fraction, seed)
    rows = sample.mapInArrow(timed, "rule string, s double, n long, rejected long").groupBy("rule").agg(F.sum("s"), F.sum("n"), F.sum("rejected")).collect()
    found = {r[0]: (r[1] / max(r[2], 1), r[3] / max(r[2], 1)) for r in rows}
    place = {r.name: i for i, r in enumerate(rules)}
    stats = [(r.name, *found.get(r.name, (0.0, 0.0))) for r in rules]
    return sorted(stats, key=lambda x: (-x[2] / max(x[1], 1e-9), place[x[0]]))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT, report: tuple[str, ...] = (), text: str = "text", fraction: float = 0.01) -> DataFrame:
    """The rows of `docs` with the measures in `report` (long), `base_failed` and `kept`.

    Reported measures are computed for every row, all others only for rows the cascade still
    holds. A null or empty text has no words, so it fails the base rules. Equal rows get equal
    verdicts. Input columns named like an output are replaced, all others are passed on. An empty
    table gives an empty result.
    """
    by_name = {r.name: r for r in rules}
    cascade = [by_name[name] for name, _, _ in estimate(docs, rules, text, fraction)]
    outputs = [*report, "base_failed", "kept"]
    docs, names, (text,) = plain(docs, outputs, text)
    base = [m for r in BASE for m in r.measures]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lazy = _Lazy(_texts(batch, text))
            every = np.arange(batch.num_rows)
            reported = {m: lazy.get(m, every) for m in dict.fromkeys([*report, *base])}
            failed = np.zeros(batch.num_rows, bool)
            for rule in BASE:
                failed |= rule.rejects(*(reported[m] for m in rule.measures))
            left = np.flatnonzero(~failed)
            for rule in cascade:
                left = left[~rule.rejects(*(lazy.get(m, left) for m in rule.measures))]
            kept = np.zeros(batch.num_rows, bool)
            kept[left] = True
            extra = [pa.array(reported[m]) for m in report] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *outputs])

    fields = [T.StructField(m, T.LongType()) for m in report] + [T.StructField(x, T.BooleanType()) for x in outputs[-2:]]
    return docs.mapInArrow(judged, T.StructType([*docs.schema.fields, *fields])).toDF(*names, *outputs)


#: DuckDB: the measures of `documents`, by doc_id.
MEASURES_SQL = r"""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents)
LEFT JOIN (SELECT doc_id, count(DISTINCT spot) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents)))
    WHERE n > 1) GROUP BY doc_id) USING (doc_id)
"""


def rules_sql(rules: tuple[Rule, ...] = DEFAULT) -> str:
    failed = " OR ".join(f"({r.sql})" for r in BASE)
    rejected = " OR ".join(f"({r.sql})" for r in rules)
    return f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT ({rejected}) AS kept FROM ({MEASURES_SQL})"
