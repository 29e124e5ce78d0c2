"""Sequence scoring to published predictions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import denormalise, round_half_even
from ..functions.timeparts import interval
from ..operators.sequences import score_sequences
from .features import FEATURE_COLS


def predict(
    features: DataFrame,
    scorer: Callable[[np.ndarray], np.ndarray],
    keys: list[str] | None = None,
    cols: list[str] | None = None,
    length: int = 168,
    out: str = "dst_predictions",
) -> DataFrame:
    """(keys, time one hour after the sequence, denormalised and rounded prediction)."""
    keys = keys or []
    scored = score_sequences(features, keys, "time", cols or FEATURE_COLS, scorer, length)
    return scored.select(
        *keys, (F.col("time") + interval("1 hour")).alias("time"), round_half_even(denormalise(F.col("score"))).alias(out)
    )
