"""The whole batch job: landed feeds to the five serving frames, and their publication."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.publish import LOOKBACK_HOURS, RETENTION, publish, sync_marker, upsert_lookback
from ..schemas import SERVING
from ..session import staged
from .features import prepare_features
from .indices import clean_feed
from .predict import predict
from .solar import clean_solar


def transform(
    feeds: dict[str, DataFrame | None],
    scorer: Callable[[np.ndarray], np.ndarray],
    keys: list[str] | None = None,
    length: int = 168,
    rates: str | None = None,
) -> dict[str, DataFrame]:
    """solar, dst, kp, ssn and dst_predictions from the raw feeds; `rates` as in `clean_solar`."""
    keys = keys or []
    solar = clean_solar(feeds["mag"], feeds["plasma"], feeds.get("old_mag"), feeds.get("old_plasma"), keys, rates=rates)
    solar = staged(solar, "solar")
    smoothed = clean_feed("smoothed_ssn", feeds["smoothed_ssn"], keys)
    features = staged(prepare_features(solar, smoothed, keys), "features")
    return {
        "solar": solar,
        "dst": clean_feed("dst", feeds["dst"], keys),
        "kp": clean_feed("kp", feeds["kp"], keys),
        "ssn": clean_feed("ssn", feeds["ssn"], keys),
        # Publishing looks for the newest row and the touched months first; score only once.
        "dst_predictions": staged(predict(features, scorer, keys, length=length), "predictions"),
    }


def publish_all(
    spark: SparkSession,
    root: str,
    frames: dict[str, DataFrame],
    now: Column,
    keys: list[str] | None = None,
    upsert_hours: int | None = None,
) -> None:
    """Upserts the recent slice of each frame, trims to retention and records the run."""
    keys = keys or []
    for name, cols in SERVING.items():
        hours = LOOKBACK_HOURS[name] if upsert_hours is None else upsert_hours
        recent = upsert_lookback(frames[name], "time", hours, keys)
        publish(spark, f"{root}/{name}", recent, [*keys, "time"], cols, now, keep=RETENTION[name])
    sync_marker(spark, f"{root}/metadata", now)
