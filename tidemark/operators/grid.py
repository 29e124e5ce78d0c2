"""Regular time grids and the joins that put series on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeparts import epoch_seconds, from_epoch_seconds, seconds_of


def regular_grid(
    frames: list[DataFrame], keys: list[str], time: str, step: str = "1 minute", chunk: str = "1 day"
) -> DataFrame:
    """(keys, time) rows at every step between the first and last time of all `frames`.

    The range is cut into chunks first and the chunks are exchanged, so the rows of one long
    series are generated by many tasks. The origin is floored to the step.
    """
    step_s, chunk_s = seconds_of(step), seconds_of(chunk)
    if chunk_s % step_s:
        raise ValueError("chunk must be a whole number of steps")
    stamps = reduce(DataFrame.unionByName, [f.select(*keys, time) for f in frames])
    seconds = epoch_seconds(F.col(time))
    bounds = stamps.groupBy(*keys).agg(F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi"))
    bounds = bounds.where(F.col("_lo").isNotNull()).withColumn("_lo", F.col("_lo") - F.pmod("_lo", F.lit(step_s)))
    chunk_of = lambda c: F.floor(F.col(c) / chunk_s).cast("bigint")
    chunks = bounds.withColumn("_chunk", F.explode(F.sequence(chunk_of("_lo"), chunk_of("_hi"))))
    start = F.greatest(F.col("_lo"), F.col("_chunk") * chunk_s)
    stop = F.least(F.col("_hi"), F.col("_chunk") * chunk_s + (chunk_s - step_s))
    spots = chunks.repartition(*keys, "_chunk").select(
        *keys, F.explode(F.sequence(start, stop, F.lit(step_s).cast("bigint"))).alias("_at")
    )
    return spots.select(*keys, from_epoch_seconds(F.col("_at")).alias(time))


def reindex(
    frames: list[DataFrame],
    keys: list[str],
    time: str,
    step: str = "1 minute",
    chunk: str = "1 day",
    spans: list[DataFrame] | None = None,
) -> DataFrame:
    """All columns of all frames on their common grid; off-grid rows vanish, gaps are NULL.

    `spans` are frames with the same times as `frames` but cheaper to scan, for the bounds.
    """
    out = regular_grid(spans or frames, keys, time, step, chunk)
    for frame in frames:
        out = out.join(frame, [*keys, time], "left")
    return out


def outer_join_series(left: DataFrame, right: DataFrame, keys: list[str], time: str) -> DataFrame:
    return left.join(right, [*keys, time], "full")


def anti_append(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Old rows win; only new times are appended."""
    return old.unionByName(new.join(old.select(*keys, time), [*keys, time], "left_anti"))


def left_join_predictions(
    predictions: DataFrame, observed: DataFrame, keys: list[str], time: str
) -> DataFrame:
    """Predictions drive; a prediction ahead of the observations keeps a NULL there."""
    return predictions.join(observed, [*keys, time], "left")


def overlay(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Delta rows replace base rows of the same key as a whole; new keys are added."""
    cols = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols])
    d = delta.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in cols], F.lit(True).alias("_hit"))
    return b.join(d, keys, "full").select(
        *[
            F.col(c) if c in keys else F.when(F.col("_hit"), F.col(f"_d_{c}")).otherwise(F.col(f"_b_{c}")).alias(c)
            for c in base.columns
        ]
    )
