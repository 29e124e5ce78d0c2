"""Serving tables: change-only upserts, retention and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timeparts import floor_time, interval, month_key
from ..session import staged
from ..sources.tables import list_partitions, read_or_empty

MONTH = "month"

# Upsert lookback in hours, retention, days held for serving, refresh seconds.
LOOKBACK_HOURS = {"solar": 24, "dst": 168, "dst_predictions": 168, "kp": 168, "ssn": 168}
RETENTION = {"solar": "1 year", "dst": "1 year", "dst_predictions": "1 year", "kp": "1 year", "ssn": "12 years"}
HELD_DAYS = {"solar": 31, "dst": 31, "dst_predictions": 31, "kp": 31, "ssn": None}
REFRESH_SECONDS = {"solar": 30, "dst": 60, "dst_predictions": 60, "kp": 120, "ssn": 300}


def diff_upsert(
    base: DataFrame, delta: DataFrame, keys: list[str], cols: list[str], now: Column, changed_flag: bool = False
) -> DataFrame:
    """base overlaid by delta; updated_at moves only for inserted and really changed rows."""
    b = base.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in cols], F.col("updated_at").alias("_b_at"), F.lit(True).alias("_old"))
    d = delta.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in cols], F.lit(True).alias("_new"))
    both = b.join(d, keys, "full")
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(f"_b_{c}").eqNullSafe(F.col(f"_d_{c}"))
    changed = F.col("_new").isNotNull() & (F.col("_old").isNull() | differs)
    out = both.select(
        *keys,
        *[F.when(F.col("_new"), F.col(f"_d_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in cols],
        F.when(changed, now).otherwise(F.col("_b_at")).alias("updated_at"),
        changed.alias("_changed"),
    )
    return out if changed_flag else out.drop("_changed")


def newest(df: DataFrame, time: str) -> Column:
    """The table's newest time as a scalar subquery."""
    return df.agg(F.max(time)).scalar()


def upsert_lookback(df: DataFrame, time: str, hours: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of the last `hours` before the newest row, of each series if it has keys."""
    return slice_interval(df, time, f"{hours} hours", keys)


def retention_trim(df: DataFrame, time: str, keep: str | None, keys: list[str] | None = None) -> DataFrame:
    """Rows no older than `keep` before the newest row (of each series); None keeps all."""
    return df if keep is None else slice_interval(df, time, keep, keys)


def change_feed(
    table: DataFrame,
    cursor: Column | None,
    time: str = "time",
    held_days: int | None = None,
    overlap: str | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Rows written after the cursor (all of them on the first read), inside each series' held window.

    `overlap` re-reads that much before the cursor, for writers whose commit lags their timestamp;
    the merge that follows is idempotent.
    """
    rows = retention_trim(table, time, f"{held_days} days" if held_days else None, keys)
    if cursor is None:
        return rows
    if overlap:
        return rows.where(F.col("updated_at") >= cursor - interval(overlap))
    return rows.where(F.col("updated_at") > cursor)


def delta_merge(
    held: DataFrame, delta: DataFrame, keys: list[str], time: str, held_days: int | None
) -> tuple[DataFrame, DataFrame]:
    """(new state, changed keys still held): overlay by key, then trim to each series' held window.

    `keys` identify a row; those besides `time` identify its series.
    """
    from .grid import overlay

    series = [k for k in keys if k != time]
    state = retention_trim(overlay(held, delta, keys), time, f"{held_days} days" if held_days else None, series)
    changed = delta.select(*keys).distinct().join(state.select(*keys), keys, "left_semi")
    return state, changed


def publish(
    spark: SparkSession,
    path: str,
    delta: DataFrame,
    keys: list[str],
    cols: list[str],
    now: Column,
    time: str = "time",
    keep: str | None = None,
) -> None:
    """diff_upsert into a month-partitioned serving table, rewriting only the touched months.

    The overwrite is dynamic: files go to a staging folder and replace their partitions at job
    commit, so lost tasks are retried against unchanged input. Repeating a publish changes nothing.
    """
    fresh = delta.select(*keys, *cols).withColumn(MONTH, month_key(F.col(time)))
    months = sorted(r[0] for r in fresh.select(MONTH).distinct().collect())  # calendar-bounded
    present = set(list_partitions(spark, path, MONTH))
    stamp = now.cast("timestamp_ntz")
    if present & set(months):
        base = spark.read.parquet(path).where(F.col(MONTH).isin(months))
        rows = diff_upsert(base, fresh, [MONTH, *keys], cols, stamp)
    else:
        rows = fresh.withColumn("updated_at", stamp)
    (
        rows.repartitionByRange(MONTH, *keys)
        .sortWithinPartitions(MONTH, *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )
    if keep:
        trim_table(spark, path, time, keep, [k for k in keys if k != time])


def trim_table(spark: SparkSession, path: str, time: str, keep: str, keys: list[str] | None = None) -> None:
    """Retention on a month-partitioned table: whole old months go, boundary months are rewritten.

    Every series keeps its own span. Their cutoffs lie in the months between the oldest and the
    newest one; only those months are read in full and replaced.
    """
    months = list_partitions(spark, path, MONTH)
    if not months:
        return
    if keys:
        _trim_series(spark, path, time, keep, keys, months)
        return
    table = spark.read.parquet(path)
    top = table.where(F.col(MONTH) == months[-1]).agg(F.max(time).alias("t"))
    cutoff, month = top.select((F.col("t") - interval(keep)).alias("c")).select("c", month_key(F.col("c"))).first()
    drop_partitions(spark, path, [m for m in months if m < month])
    if month in months:
        (
            spark.read.parquet(path)
            .where((F.col(MONTH) == month) & (F.col(time) >= F.lit(cutoff).cast("timestamp_ntz")))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(MONTH)
            .parquet(path)
        )


def _trim_series(spark: SparkSession, path: str, time: str, keep: str, keys: list[str], months: list[str]) -> None:
    table = spark.read.parquet(path)
    trim_before(spark, path, time, keys, table.groupBy(*keys).agg((F.max(time) - interval(keep)).alias("_from")), months)


def trim_before(spark: SparkSession, path: str, time: str, keys: list[str], cutoffs: DataFrame, months: list[str]) -> None:
    """Drops each series' rows before its own `_from` from a month-partitioned table.

    Months before the earliest cutoff go by their folders; only those between the earliest and the
    latest one are rewritten. In these, rows of a series without a cutoff go.
    """
    cutoffs = staged(cutoffs, "cutoffs")
    ends = cutoffs.agg(month_key(F.min("_from")), month_key(F.max("_from"))).first()
    if ends[0] is None:
        return
    drop_partitions(spark, path, [m for m in months if m < ends[0]])
    boundary = [m for m in months if ends[0] <= m <= ends[1]]
    if not boundary:
        return
    rows = spark.read.parquet(path).where(F.col(MONTH).isin(boundary)).join(cutoffs, keys)
    kept = staged(rows.where(F.col(time) >= F.col("_from")).drop("_from"), "kept")
    left = {r[0] for r in kept.select(F.col(MONTH).cast("string")).distinct().collect()}  # calendar-bounded
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    drop_partitions(spark, path, [m for m in boundary if m not in left])


def drop_partitions(spark: SparkSession, path: str, months: list[str]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for month in months:
        folder = hadoop(f"{path}/{MONTH}={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def sync_marker(spark: SparkSession, path: str, now: Column) -> None:
    """One-row table holding the time of the last run."""
    row = spark.range(1).select(now.cast("timestamp_ntz").alias("last_synced"))
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def slice_interval(df: DataFrame, time: str, span: str, keys: list[str] | None = None) -> DataFrame:
    """Rows within `span` of the newest row (of each series), whatever the clock says."""
    if not keys:
        return df.where(F.col(time) >= newest(df, time) - interval(span))
    anchors = df.groupBy(*keys).agg((F.max(time) - interval(span)).alias("_from"))
    return df.join(anchors, keys).where(F.col(time) >= F.col("_from")).drop("_from").select(*df.columns)


def slice_published(
    spark: SparkSession, path: str, time: str, span: str, keys: list[str] | None = None, schema: str | None = None
) -> DataFrame:
    """slice_interval over a month-partitioned table that reads only the months it needs.

    A table not published yet gives no rows, under `schema`.

    The newest time is read from the last month, or the newest one of each series from all months
    (keys and time only); months before the earliest cutoff are filtered out by partition.
    """
    months = list_partitions(spark, path, MONTH)
    if not months:
        return read_or_empty(spark, path, schema or f"{time} timestamp_ntz, {MONTH} string").limit(0)
    table = spark.read.parquet(path)
    if not keys:
        top = table.where(F.col(MONTH) == months[-1]).agg((F.max(time) - interval(span)).alias("c"))
        cutoff, month = top.select("c", month_key(F.col("c"))).first()
        return table.where((F.col(MONTH) >= month) & (F.col(time) >= F.lit(cutoff).cast("timestamp_ntz")))
    anchors = table.groupBy(*keys).agg((F.max(time) - interval(span)).alias("_from"))
    month = anchors.agg(month_key(F.min("_from"))).first()[0]
    recent = table.where(F.col(MONTH) >= month)
    return recent.join(anchors, keys).where(F.col(time) >= F.col("_from")).drop("_from").select(*table.columns)


def latest_published(spark: SparkSession, path: str, time: str, schema: str | None = None) -> DataFrame:
    """The newest row of a month-partitioned table, from its last month; none, under `schema`, before it is published."""
    from .carry import latest_row

    months = list_partitions(spark, path, MONTH)
    if not months:
        return read_or_empty(spark, path, schema or f"{time} timestamp_ntz, {MONTH} string").limit(0)
    table = spark.read.parquet(path)
    return latest_row(table.where(F.col(MONTH) == months[-1]), time)


def latest_snapshot(df: DataFrame, product: list[str], retrieved: str) -> DataFrame:
    """Rows of the newest retrieval of each product."""
    top = df.groupBy(*product).agg(F.max(retrieved).alias(retrieved))
    return df.join(top, [*product, retrieved], "left_semi")


def table_health(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and last change per table, and whether all of them have data yet; every table is read once."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count("*").alias("rows"), F.max("updated_at").alias("last_updated_at")).select(
            F.lit(name).alias("table"), "rows", "last_updated_at"
        )
        out = row if out is None else out.unionByName(row)
    # One row for each table: the window sees no more than that.
    warm = F.bool_and(F.col("last_updated_at").isNotNull()).over(Window.partitionBy())
    return out.withColumn("status", F.when(warm, "ok").otherwise("warming_up"))


def feed_silence(log: DataFrame, feed: str, at: str, ok: str, as_of: Column, limit: str = "1 hour") -> DataFrame:
    """Per feed the last success and whether it is older than `limit` before `as_of`."""
    last = log.groupBy(feed).agg(F.max(F.when(F.col(ok), F.col(at))).alias("last_ok"))
    silent = F.col("last_ok").isNull() | (F.col("last_ok") < as_of - interval(limit))
    return last.withColumn("silent", silent)


def fetch_counts(log: DataFrame, feed: str, ok: str) -> DataFrame:
    return log.groupBy(feed).agg(F.count_if(F.col(ok)).alias("successes"), F.count_if(~F.col(ok)).alias("failures"))


def partition_union(existing: DataFrame, touched: DataFrame) -> DataFrame:
    """Sorted set union of partition names."""
    return existing.union(touched).distinct()


def hours_of(times: DataFrame, keys: list[str], time: str, unit: str = "hour") -> DataFrame:
    """Distinct buckets of changed times."""
    return times.select(*keys, floor_time(F.col(time), unit).alias("bucket")).distinct()
