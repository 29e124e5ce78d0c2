"""Structured Streaming forms of the incremental operators.

Watermarks need TIMESTAMP, so streams cast their TIMESTAMP_NTZ time column; outputs cast back.
Checkpoints and tables live in folders shared by all executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import round_mean
from ..functions.timeparts import floor_time, interval, month_key
from ..operators.buckets import SLOTS, recompute_touched, slots_seen
from ..operators.grid import left_join_predictions
from ..operators.merge import last_wins
from ..operators.publish import MONTH, REFRESH_SECONDS, drop_partitions, publish, retention_trim, trim_before
from ..sources.tables import exists, list_partitions


def event_time(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp"))


def stream_bucket_mean(
    stream: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    unit: str = "hour",
    lateness: str = "2 hours",
    digits: int = 2,
    out: str = "time",
) -> DataFrame:
    """Complete-bucket means, each emitted once when the watermark passes the bucket's end."""
    slot, expected = SLOTS[unit]
    rows = event_time(stream, time).withWatermark(time, lateness)
    means = rows.groupBy(*keys, F.window(time, f"1 {unit}").alias("_w")).agg(
        slots_seen(slot(F.col(time))).alias("_slots"), *[F.avg(c).alias(c) for c in cols]
    )
    return means.where(F.col("_slots") == expected).select(
        *keys, F.col("_w.start").cast("timestamp_ntz").alias(out), *[round_mean(F.col(c), digits).alias(c) for c in cols]
    )


def stream_dedupe(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 day") -> DataFrame:
    """First record per key within the lateness; state older than that is dropped."""
    rows = event_time(stream, time).withWatermark(time, lateness)
    return rows.dropDuplicatesWithinWatermark(keys).withColumn(time, F.col(time).cast("timestamp_ntz"))


def upsert_stream(
    spark: SparkSession,
    stream: DataFrame,
    table: str,
    checkpoint: str,
    keys: list[str],
    cols: list[str],
    time: str = "time",
    seq: str | None = None,
    keep: str | None = None,
    now: Column | None = None,
    after: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Change-only upsert of every micro-batch; `after` sees the batch's changed keys.

    A replayed batch finds its rows already stored and changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = last_wins(batch.select(*keys, *cols, *([seq] if seq else [])), keys, seq)
        # Read by the month listing, the upsert and the hook; a lost block is recomputed.
        rows = rows.persist()
        try:
            publish(spark, table, rows, keys, cols, now if now is not None else F.localtimestamp(), time, keep)
            if after is not None:
                after(rows.select(*keys))
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def refresh_buckets(
    spark: SparkSession,
    base: str,
    published: str,
    keys: list[str],
    time: str,
    cols: list[str],
    unit: str = "hour",
    held_days: int | None = None,
) -> Callable[[DataFrame], None]:
    """An `after` hook that recomputes only the buckets a batch touched.

    Both tables are partitioned by month. The months that a touched bucket starts in are rewritten;
    the rows come from those and the months the buckets reach into, as a week may cross from one to
    the next. With `held_days` buckets older than the oldest row still held go.
    """
    if unit not in SLOTS:
        raise ValueError(f"unknown bucket unit: {unit}")
    reach = {"hour": "0 days", "day": "0 days", "week": "6 days"}[unit]

    def refresh(changed: DataFrame) -> None:
        start = floor_time(F.col(time), unit)
        spans = changed.select(month_key(start).alias("a"), month_key(start + interval(reach)).alias("b")).distinct().collect()  # calendar-bounded
        months = sorted({r.a for r in spans})
        sources = sorted({m for r in spans for m in (r.a, r.b)})
        held = set(list_partitions(spark, published, MONTH))
        rows = spark.read.parquet(base).where(F.col(MONTH).isin(sources)).select(*keys, time, *cols)
        current = rows.limit(0)
        if held & set(months):
            current = spark.read.parquet(published).where(F.col(MONTH).isin(months)).select(*keys, time, *cols)
        fresh = recompute_touched(rows, changed, current, keys, time, cols, unit).withColumn(MONTH, month_key(F.col(time)))
        kept = {r[0] for r in fresh.select(MONTH).distinct().collect()}
        fresh.repartitionByRange(MONTH, *keys, time).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(MONTH).parquet(published)
        drop_partitions(spark, published, sorted((set(months) & held) - kept))
        if held_days:
            prune_published(spark, base, published, time, unit, held_days, keys)

    return refresh


def prune_published(spark: SparkSession, base: str, published: str, time: str, unit: str, held_days: int, keys: list[str] | None = None) -> None:
    """Drops published buckets older than the bucket of the oldest row still held of `base`, of each series.

    Whole months go by their folders; the boundary months are rewritten.
    """
    months = list_partitions(spark, base, MONTH)
    if not months or not list_partitions(spark, published, MONTH):
        return
    if keys:
        held = retention_trim(spark.read.parquet(base).select(*keys, time), time, f"{held_days} days", keys)
        oldest = held.groupBy(*keys).agg(floor_time(F.min(time), unit).alias("_from"))
        trim_before(spark, published, time, keys, oldest, list_partitions(spark, published, MONTH))
        return
    top = spark.read.parquet(base).where(F.col(MONTH) == months[-1]).agg((F.max(time) - interval(f"{held_days} days")).alias("c"))
    cutoff, month = top.select("c", month_key(F.col("c"))).first()
    oldest = spark.read.parquet(base).where((F.col(MONTH) >= month) & (F.col(time) >= F.lit(cutoff).cast("timestamp_ntz"))).agg(F.min(time).alias("t"))
    first, month = oldest.select(floor_time(F.col("t"), unit).alias("f")).select("f", month_key(F.col("f"))).first()
    present = list_partitions(spark, published, MONTH)
    drop_partitions(spark, published, [m for m in present if m < month])
    if month in present:
        kept = spark.read.parquet(published).where((F.col(MONTH) == month) & (F.col(time) >= F.lit(first).cast("timestamp_ntz")))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(published)


def refresh_join(spark: SparkSession, predictions: str, observed: str, published: str) -> Callable[[DataFrame], None]:
    """An `after` hook that rebuilds the small predictions-with-observations table whole."""

    def refresh(_: DataFrame) -> None:
        if not (exists(spark, predictions) and exists(spark, observed)):
            return
        left = spark.read.parquet(predictions).select("time", "dst_predictions")
        right = spark.read.parquet(observed).select("time", "dst")
        left_join_predictions(left, right, [], "time").write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).parquet(published)

    return refresh


def write_table(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append-mode file sink, run to the end of the available input."""
    return (
        stream.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def cadence(table: str) -> dict[str, str]:
    """Trigger settings of a table's refresh query."""
    return {"processingTime": f"{REFRESH_SECONDS[table]} seconds"}
