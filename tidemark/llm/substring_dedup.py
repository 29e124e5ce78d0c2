"""Substring deduplication over words, by an FM-index in every shard.

A window is `window` consecutive words of one document. Words covered by a window that also starts
earlier (smaller document number, or earlier in the same document) are removed; windows are judged
on the input. `repeats` routes the text so that equal windows meet in one shard, whose FM-index
(wavelet matrix, backward search) reports the matches. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import plain
from .fm_index import FMIndex
from .repeats import PART, RANK, TIE, Scheme, texts_of, without_repeats

OUTPUTS = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 8, id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """The rows of `docs` with `n_words`, `n_removed` and `kept_text` (kept words, one space between).

    A text without words, empty or null, has n_words 0 and an empty kept_text; texts shorter than
    the window lose nothing; long texts are handled whole. Rows without a number rank last, equal
    rows don't remove each other, rows that repeat a number count as one document. Input columns
    named like an output are replaced; all others, whatever their names, are passed on. An empty
    table gives an empty result. `sizes` are those of `repeats.Scheme`.
    """
    outputs = [f.name for f in OUTPUTS]
    docs, names, (id, text) = plain(docs, outputs, id, text)
    scheme = Scheme(window=window, gram=min(gram, window), units="words", same_document=True, index=FMIndex, **sizes)

    def finish(rows: pa.Table, spans: list[np.ndarray | None]) -> pa.Table:
        total, removed, kept = [], [], []
        for data, own in zip(texts_of(rows, text), spans, strict=True):
            words = data.split()
            total.append(len(words))
            if own is not None:
                left, at = [], 0
                for a, b in own:
                    left += words[at:a]
                    at = b
                words = left + words[at:]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode())
        out = rows.drop_columns([PART, RANK, TIE])
        return out.append_column("n_words", pa.array(total, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())).append_column("kept_text", pa.array(kept, pa.string()))

    rows = without_repeats(docs, scheme, finish, T.StructType([*docs.schema.fields, *OUTPUTS]), id, text)
    return rows.toDF(*names, *outputs)
