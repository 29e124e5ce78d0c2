"""Tumbling-bucket aggregates that publish complete buckets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_mean
from ..functions.timeparts import floor_time
from .grid import regular_grid

SLOTS = {  # bucket unit -> (slot of a time inside its bucket, slots in a full bucket)
    "hour": (lambda t: F.minute(t), 60),
    "day": (lambda t: F.hour(t), 24),
    "week": (lambda t: F.weekday(t), 7),
}


GRIDS = {"hour": ("1 hour", "30 days"), "day": ("1 day", "365 days")}  # bucket unit -> (grid step, chunk)


def slots_seen(slot: Column) -> Column:
    """Distinct slots present, as a bit mask: a fixed-width, mergeable count of up to 63 slots."""
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)))


def complete_bucket_mean(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    unit: str = "hour",
    digits: int | None = 2,
    out: str = "time",
) -> DataFrame:
    """Mean of every column per bucket; a bucket with a missing slot is absent, not partial."""
    slot, expected = SLOTS[unit]
    rows = df.groupBy(*keys, floor_time(F.col(time), unit).alias("_start")).agg(
        slots_seen(slot(F.col(time))).alias("_slots"), *[F.avg(c).alias(c) for c in cols]
    )
    value = (lambda c: round_mean(F.col(c), digits)) if digits is not None else F.col
    return rows.where(F.col("_slots") == expected).select(
        *keys, F.col("_start").alias(out), *[value(c).alias(c) for c in cols]
    )


def complete_bucket_stats(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    unit: str = "hour",
    expected: int | None = None,
    emit_empty: bool = False,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """<col>_mean and <col>_std (sample) per bucket holding exactly `expected` values of cols[0].

    emit_empty adds NULL rows for the buckets missing between a series' first and last kept one.
    """
    expected = SLOTS[unit][1] if expected is None else expected
    if emit_empty and unit not in GRIDS:
        raise ValueError(f"empty buckets need one of the units {sorted(GRIDS)}, not {unit}")
    stats = [f(c).alias(f"{c}_{name}") for c in cols for name, f in (("mean", F.avg), ("std", F.stddev_samp))]
    rows = (
        df.groupBy(*keys, floor_time(F.col(time), unit).alias("_start"))
        .agg(F.count(cols[0]).alias("_n"), *stats)
        .where(F.col("_n") == expected)
        .drop("_n", *drop)
        .withColumnRenamed("_start", time)
    )
    if not emit_empty:
        return rows
    step, chunk = GRIDS[unit]
    return regular_grid([rows], keys, time, step, chunk).join(rows, [*keys, time], "left")


def in_complete_bucket(df: DataFrame, keys: list[str], time: str, col: str, unit: str, expected: int) -> DataFrame:
    """The rows whose bucket holds exactly `expected` non-NULL values of `col`."""
    start = floor_time(F.col(time), unit)
    full = (
        df.groupBy(*keys, start.alias("_start"))
        .agg(F.count(col).alias("_n"))
        .where(F.col("_n") == expected)
        .drop("_n")
    )
    return df.withColumn("_start", start).join(full, [*keys, "_start"], "left_semi").drop("_start")


def monthly_mean(df: DataFrame, keys: list[str], time: str, col: str, out: str = "monthly_mean") -> DataFrame:
    """Mean of the available days of each calendar month, rounded half up to 2 digits."""
    month = floor_time(F.col(time), "month").alias("month")
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*keys, month)
        .agg(round_mean(F.avg(col), 2, half_up=True).alias(out))
    )


def recompute_touched(
    base: DataFrame,
    changed: DataFrame,
    published: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    unit: str = "hour",
) -> DataFrame:
    """`published` with only the buckets of the changed times recomputed from `base`.

    A touched bucket that is not complete any more disappears.
    """
    start = floor_time(F.col(time), unit)
    touched = changed.select(*keys, start.alias("_start")).distinct()
    rows = base.withColumn("_start", start).join(touched, [*keys, "_start"], "left_semi").drop("_start")
    fresh = complete_bucket_mean(rows, keys, time, cols, unit, out=time)
    kept = published.join(touched.withColumnRenamed("_start", time), [*keys, time], "left_anti")
    return kept.unionByName(fresh)


def prune_buckets(published: DataFrame, held: DataFrame, time: str, unit: str = "hour", keys: list[str] | None = None) -> DataFrame:
    """Drops buckets older than the bucket of the oldest held row, of each series if it has keys.

    A series without a held row keeps no bucket.
    """
    if keys:
        oldest = held.groupBy(*keys).agg(floor_time(F.min(time), unit).alias("_first"))
        return published.join(oldest, keys).where(F.col(time) >= F.col("_first")).select(*published.columns)
    oldest = held.agg(F.min(time).alias("t")).select(floor_time(F.col("t"), unit)).scalar()
    return published.where(F.col(time) >= oldest)
