"""Hourly model features from the clean minute series."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalar import FEATURE_STATS, normalise
from ..operators.asof import asof_slow
from ..operators.buckets import complete_bucket_stats
from ..operators.clean import drop_incomplete
from ..schemas import FEATURES

FEATURE_COLS = [f"{c}_{s}" for c in FEATURES for s in ("mean", "std")][:-1]


def join_smoothed(solar: DataFrame, smoothed: DataFrame, keys: list[str]) -> DataFrame:
    """Newest monthly value at or before each minute; rows with any NULL drop out."""
    return drop_incomplete(asof_slow(solar, smoothed, keys, "time", "predicted_ssn"))


def prepare_features(
    solar: DataFrame, smoothed: DataFrame, keys: list[str] | None = None, stats: dict = FEATURE_STATS, emit_empty: bool = True
) -> DataFrame:
    """(keys, time, 15 features) per hour with all 60 minutes, normalised before averaging."""
    keys = keys or []
    rows = join_smoothed(solar, smoothed, keys)
    rows = rows.select(*keys, "time", *[normalise(c, stats).alias(c) for c in FEATURES])
    return complete_bucket_stats(
        rows, keys, "time", FEATURES, "hour", emit_empty=emit_empty, drop=("predicted_ssn_std",)
    )
