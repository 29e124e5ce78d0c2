"""Fixed-length row sequences and batch scoring over them."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .carry import positions

BLOCK = "_block"


def _blocks(
    df: DataFrame, keys: list[str], time: str, length: int, block: int, width: str, step: str | None = None
) -> DataFrame:
    """Rows in blocks of `block` positions, each led by the last length-1 rows of the one before.

    Blocks are cut by row position, not by time, so gaps never shorten the lead-in. `step` says that
    the rows lie on a regular grid without gaps, which saves counting them.
    """
    if block < length:
        raise ValueError("block must be at least the sequence length")
    placed = positions(df, keys, time, width, "_pos", step)
    home = F.floor(F.col("_pos") / block).cast("bigint")
    lead_in = F.pmod("_pos", F.lit(block)) >= block - (length - 1)
    targets = F.when(lead_in, F.array(home, home + 1)).otherwise(F.array(home))
    return placed.withColumn("_home", home).withColumn(BLOCK, F.explode(targets))


def sequences(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    length: int = 168,
    block: int = 2048,
    width: str = "30 days",
) -> DataFrame:
    """(keys, time of the last row, seq): every run of `length` consecutive rows, stride 1.

    Each row is copied `length` times: for small exports. `score_sequences` scores without copies.
    """
    parts = _blocks(df, keys, time, length, block, width)
    run = Window.partitionBy(*keys, BLOCK).orderBy("_pos").rowsBetween(-(length - 1), 0)
    return (
        parts.withColumn("seq", F.collect_list(F.struct(*cols)).over(run))
        .where((F.size("seq") == length) & (F.col("_home") == F.col(BLOCK)))
        .select(*keys, time, "seq")
    )


class LinearScorer:
    """Deterministic stand-in for a model: a fixed weight per lag and feature."""

    def __init__(self, weights: np.ndarray, bias: float = 0.0):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.bias = float(bias)

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        return np.einsum("nlf,lf->n", batch, self.weights) + self.bias


class OnnxScorer:
    """Scores with an ONNX model; `path` must be readable by every executor."""

    def __init__(self, path: str, input_name: str = "input_layer:0"):
        self.path, self.input_name = path, input_name

    def __call__(self, batch: np.ndarray) -> np.ndarray:
        feed = {self.input_name: np.ascontiguousarray(batch, dtype=np.float32)}
        return np.asarray(_session(self.path).run(None, feed)[0]).reshape(-1)


def _session(path: str):
    """The open model, once per Python worker: the cache outlives the pickled scorer."""
    import onnxruntime

    cache = sys.modules.setdefault("_tidemark_models", types.ModuleType("_tidemark_models")).__dict__
    if path not in cache:
        cache[path] = onnxruntime.InferenceSession(path)
    return cache[path]


def score_sequences(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    scorer: Callable[[np.ndarray], np.ndarray],
    length: int = 168,
    block: int = 8192,
    width: str = "30 days",
    batch: int = 1024,
    out: str = "score",
    step: str | None = None,
) -> DataFrame:
    """Score of the sequence that ends at each row.

    Sequences are strided views over a block inside the task: rows cross the network once, not
    once per sequence they belong to. A block holds at most block + length - 1 rows.
    """
    parts = _blocks(df, keys, time, length, block, width, step)
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in [*keys, time]) + f", `{out}` double"

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pos")
        own = rows["_home"].to_numpy() == rows[BLOCK].to_numpy()
        ends = rows[[*keys, time]]
        if len(rows) < length:
            return ends.iloc[:0].assign(**{out: pd.Series(dtype="float64")})
        views = np.lib.stride_tricks.sliding_window_view(rows[cols].to_numpy(dtype="float64"), length, axis=0)
        views = views.transpose(0, 2, 1)
        wanted = np.flatnonzero(own[length - 1 :])
        scores = np.concatenate(
            [np.asarray(scorer(views[wanted[i : i + batch]]), dtype="float64") for i in range(0, len(wanted), batch)]
            or [np.empty(0)]
        )
        return ends.iloc[wanted + length - 1].assign(**{out: scores})

    return parts.select(*keys, time, *cols, "_pos", "_home", BLOCK).groupBy(*keys, BLOCK).applyInPandas(score, schema)


def score_batches(df: DataFrame, seq: str, scorer: Callable[[np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    """Scores an ARRAY<ARRAY<DOUBLE>> sequence column batch by batch."""
    schema = df.drop(seq).schema.add(out, "double")
    kept = df.drop(seq).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                tensor = np.stack([np.stack(s) for s in rows[seq]])
                yield rows[kept].assign(**{out: np.asarray(scorer(tensor), dtype="float64")})

    return df.mapInPandas(run, schema)
