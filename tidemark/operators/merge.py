"""Keyed last-write-wins merges and the month-partitioned raw tables they maintain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import month_key
from ..sources.payloads import DICTS, LISTS, arrival, dict_rows, list_rows, payload_rejects, sniff
from ..sources.tables import list_partitions

MONTH = "month"


# Types whose aggregation buffers are fixed-width, so max_by runs as a hash aggregation.
FIXED_WIDTH = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}
OLDEST = -(2**63)


def last_wins(df: DataFrame, keys: list[str], seq: Column | str | None = None) -> DataFrame:
    """The record with the highest `seq` per key, whole: its NULLs replace earlier values.

    A whole-number `seq` that is NULL ranks below every other. Without `seq` the greatest record
    wins, so the answer does not depend on the order of the rows.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rest = [c for c in df.columns if c not in keys]
    if seq is None:
        out = df.groupBy(*keys).agg(F.max(F.struct(*rest) if rest else F.lit(0)).alias("_r"))
        return out.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])
    if isinstance(seq, str):
        order = F.col(seq)
        if types[seq] in ("tinyint", "smallint", "int", "bigint"):
            order = F.coalesce(order.cast("bigint"), F.lit(OLDEST + 1))
    else:
        order = seq
    if all(types[c] in FIXED_WIDTH for c in rest):
        # The columns see the same rows in the same order, so they agree on the winning record.
        return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*df.columns)
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def merge_records(existing: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None, written: str | None = None) -> DataFrame:
    """Upsert of whole records; inside `new`, `seq` (integers) decides between copies of one key.

    Between the two, new records win. With `written` (a column of both, microseconds) the one written
    later does, so a delivery that was held up does not undo a newer one; a tie goes to the new record.
    """
    cols = existing.columns
    if written is not None:
        age = F.coalesce(F.col(written), F.lit(OLDEST // 4)) * 2
        fresh = last_wins(new, keys, seq).select(*cols)
        both = existing.withColumn("_o", age).unionByName(fresh.withColumn("_o", age + 1))
        return last_wins(both, keys, "_o").select(*cols)
    if seq is None:
        new, seq = last_wins(new.select(*cols), keys).withColumn("_s", F.lit(0)), "_s"
    arrival = F.coalesce(F.col(seq).cast("bigint"), F.lit(OLDEST + 1))
    old_rows = existing.withColumn("_o", F.lit(OLDEST).cast("bigint"))
    new_rows = new.withColumn("_o", arrival).select(*cols, "_o")
    return last_wins(old_rows.unionByName(new_rows), keys, "_o").select(*cols)


def _touched(new: DataFrame) -> list[str]:
    """Names of the months in a payload; their number is bounded by the calendar."""
    return sorted(r[0] for r in new.select(MONTH).distinct().collect())


def land_partitioned(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: list[str],
    time: str,
    seq: str | None = None,
    keep: list[str] | None = None,
    written: str | None = None,
) -> list[str]:
    """Merges a payload into its months of a partitioned raw table; returns those months.

    The payload is staged first: the months and the rows then come from the same copy, whatever
    arrives meanwhile. Only touched partitions are read and replaced. The files of a partition are
    sorted by key, so later time filters skip row groups. Re-running the same payload leaves the
    table as it is.
    """
    from ..session import staged

    kept = new.select(*[c for c in (keep or new.columns)], *([seq] if seq and keep and seq not in keep else []))
    kept = staged(kept.withColumn(MONTH, _month_of(kept, time)), "landing")
    months = _touched(kept)
    cols = [c for c in kept.columns if c != seq]
    present = [m for m in list_partitions(spark, path, MONTH) if m in set(months)]
    if present:
        schema = kept.select(*cols).schema
        existing = spark.read.schema(schema).parquet(path).where(F.col(MONTH).isin(present))
        merged = merge_records(existing.select(*cols), kept, [MONTH, *keys], seq, written)
    else:
        merged = last_wins(kept, [MONTH, *keys], seq).select(*cols)
    (
        merged.repartitionByRange(MONTH, *keys)
        .sortWithinPartitions(MONTH, *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )
    return months


def _month_of(df: DataFrame, time: str) -> Column:
    if df.schema[time].dataType.simpleString() == "string":
        return F.substring(time, 1, 7)
    return month_key(F.col(time))


def land_single(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], seq: str | None = None, written: str | None = None
) -> None:
    """Merge into an unpartitioned raw table: the merged rows are written beside it, then replace it.

    Should the write fail, the table holds what it held before.
    """
    from ..sources.tables import read_or_empty, replace_table, restore_table

    restore_table(spark, path)
    cols = [c for c in new.columns if c != seq]
    existing = read_or_empty(spark, path, new.select(*cols).schema)
    merged = merge_records(existing, new, keys, seq, written)
    replace_table(spark, merged.repartitionByRange(*keys).sortWithinPartitions(*keys), path)


def land_documents(
    spark: SparkSession,
    path: str,
    docs: DataFrame,
    payload: str,
    fields: dict[str, str],
    keys: list[str],
    time: str,
    partitioned: bool,
) -> None:
    """Landing by payload form: header-row lists merge into {path}/lists, records into {path}/dicts.

    A document in neither form, or malformed, stops the landing before anything is written. With a
    `document` column (see `read_documents`) later documents beat earlier ones.
    """
    bad = payload_rejects(docs, payload).groupBy("reason").count().collect()  # at most two rows
    if bad:
        raise ValueError(f"{path}: {', '.join(f'{r[1]} {r[0]}' for r in sorted(bad))}")
    keep = ["document"] if "document" in docs.columns else []
    ordered = lambda rows: rows.withColumn("seq", arrival()).drop("document") if keep else rows
    form = sniff(F.col(payload))
    lists, dicts = docs.where(form == LISTS), docs.where(form == DICTS)
    if not lists.isEmpty():
        land_single(spark, f"{path}/lists", ordered(list_rows(lists, payload, fields, keep)), keys, "seq")
    if not dicts.isEmpty():
        land(spark, f"{path}/dicts", ordered(dict_rows(dicts, payload, fields, keep)), keys, time, partitioned, "seq")


def land(
    spark: SparkSession,
    path: str,
    payload: DataFrame | None,
    keys: list[str],
    time: str,
    partitioned: bool,
    seq: str | None = None,
    keep: list[str] | None = None,
    written: str | None = None,
) -> list[str]:
    """Landing dispatch: nothing for a failed feed, else the partitioned or the single merge."""
    if payload is None:
        return []
    if partitioned:
        return land_partitioned(spark, path, payload, keys, time, seq, keep, written)
    land_single(spark, path, payload.select(*keep) if keep else payload, keys, seq, written)
    return []
