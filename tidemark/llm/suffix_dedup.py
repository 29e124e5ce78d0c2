"""Byte-level deduplication, by a run-length index in every shard.

Every byte covered by a string of `window` bytes that also starts in a document with a smaller
number is removed; strings are judged on the input and never cross documents. `repeats` routes the
text so that equal strings meet in one shard; its index is a run-compressed Burrows-Wheeler
transform with positions sampled at run ends, through which the shard's pieces are streamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import plain
from .repeats import PART, RANK, TIE, Scheme, texts_of, without_repeats
from .run_index import RunIndex

OUTPUTS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]


def suffix_dedup(docs: DataFrame, window: int = 50, gram: int = 20, id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """The rows of `docs` with `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and `kept` bytes.

    Null and empty texts have no bytes; texts shorter than the window lose nothing; long texts are
    handled whole. Rows without a number rank last; rows with the same number never remove each
    other. `kept` is binary, as a cut may fall inside a character. Input columns named like an
    output are replaced, all others are passed on. An empty table gives an empty result.
    """
    if window < 6:
        raise ValueError("the index needs windows of six bytes or more")
    outputs = [f.name for f in OUTPUTS]
    docs, names, (id, text) = plain(docs, outputs, id, text)
    scheme = Scheme(window=window, gram=min(gram, window), units="bytes", same_document=False, index=RunIndex, **sizes)

    def finish(rows: pa.Table, spans: list[np.ndarray | None]) -> pa.Table:
        total, removed, runs, kept = [], [], [], []
        for data, own in zip(texts_of(rows, text), spans, strict=True):
            total.append(len(data))
            runs.append(0 if own is None else len(own))
            if own is not None:
                left, at = [], 0
                for a, b in own:
                    left.append(data[at:a])
                    at = b
                data = b"".join([*left, data[at:]])
            removed.append(total[-1] - len(data))
            kept.append(data)
        out = rows.drop_columns([PART, RANK, TIE])
        for name, values, kind in (("n_bytes", total, pa.int64()), ("n_removed", removed, pa.int64()), ("n_spans", runs, pa.int64()), ("kept", kept, pa.binary())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    rows = without_repeats(docs, scheme, finish, T.StructType([*docs.schema.fields, *OUTPUTS]), id, text)
    return rows.toDF(*names, *outputs)
