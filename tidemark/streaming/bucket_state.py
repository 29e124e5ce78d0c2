"""Complete-bucket means kept in the state of a stream, for each series, without a table of its rows.

A bucket is a vector of slots: 60 minutes of an hour, 24 hours of a day. A row puts its values into
its slot, a later row of the same time replaces them, a removed one clears it. A bucket whose slots
are all there is emitted with its means; one that was emitted and is incomplete again, or falls out
of its series' held window, is emitted as removed. Every series holds its own window, so one that
lags keeps its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.scalar import round_mean
from ..functions.timeparts import month_key
from ..operators.buckets import SLOTS
from ..operators.publish import MONTH, drop_partitions
from ..sources.tables import list_partitions

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of a bucket and of a slot.
SPANS = {"hour": (3600, 60), "day": (86_400, 3600)}
_BUCKET = T.StructType([T.StructField("bucket", T.LongType())])
_SLOTS = T.StructType([T.StructField("mask", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("sent", T.BooleanType())])
_NEWEST = T.StructType([T.StructField("second", T.LongType())])


class BucketState(StatefulProcessor):
    """The slots of one series' buckets; see the module."""

    def __init__(self, keys: list[str], cols: list[str], unit: str, held_days: int | None) -> None:
        self.keys, self.cols, self.held = keys, cols, held_days * 86_400 if held_days else None
        self.span, self.step = SPANS[unit]
        self.size = self.span // self.step

    def init(self, handle) -> None:
        self.buckets = handle.getMapState("buckets", _BUCKET, _SLOTS)
        self.newest = handle.getValueState("newest", _NEWEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        touched: dict[int, tuple[int, np.ndarray, bool]] = {}
        # The last row of a time decides: rows come in any order, so each slot remembers its row's rank.
        ranks: dict[tuple[int, int], int] = {}
        for frame in rows:
            # By place: names of the columns do not all reach the worker as they are.
            second, seq, gone = (frame.iloc[:, len(self.keys) + i].to_numpy() for i in range(3))
            values = frame.iloc[:, len(self.keys) + 3 :].to_numpy(dtype=float, na_value=np.nan)
            present = second[~gone.astype(bool)]
            if len(present):
                newest = int(present.max()) if newest is None else max(newest, int(present.max()))
            for at, rank, removed, row in zip(second.tolist(), seq.tolist(), gone.tolist(), values, strict=True):
                bucket, slot = at // self.span * self.span, at % self.span // self.step
                if ranks.get((bucket, slot), rank) > rank:
                    continue
                ranks[bucket, slot] = rank
                mask, held, sent = touched[bucket] if bucket in touched else self._held(bucket)
                held[slot] = np.nan if removed else row
                mask = mask & ~(1 << slot) if removed else mask | 1 << slot
                touched[bucket] = mask, held, sent
        out = []
        first = newest - self.held if newest is not None and self.held else None
        for bucket, (mask, held, sent) in sorted(touched.items()):
            if self._expired(bucket, mask, first):
                if sent:
                    out.append((bucket, None))
                if self.buckets.containsKey((bucket,)):
                    self.buckets.removeKey((bucket,))
                continue
            whole = mask == (1 << self.size) - 1
            if whole:
                out.append((bucket, held))
            elif sent:
                out.append((bucket, None))
            if mask:
                self.buckets.updateValue((bucket,), (mask, held.ravel().tolist(), whole))
            elif self.buckets.containsKey((bucket,)):
                self.buckets.removeKey((bucket,))
        if newest is not None:
            self.newest.update((newest,))
        if first is not None:
            for bucket in [b for (b,) in self.buckets.keys() if b not in touched and b <= first]:
                mask, _, sent = self._held(bucket)
                if self._expired(bucket, mask, first):
                    self.buckets.removeKey((bucket,))
                    if sent:
                        out.append((bucket, None))
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _held(self, bucket: int) -> tuple[int, np.ndarray, bool]:
        if self.buckets.containsKey((bucket,)):
            mask, values, sent = self.buckets.getValue((bucket,))
            return int(mask), np.array(values, float).reshape(self.size, len(self.cols)), bool(sent)
        return 0, np.full((self.size, len(self.cols)), np.nan), False

    def _expired(self, bucket: int, mask: int, first: int | None) -> bool:
        """Whether no row of the bucket is as new as `first`."""
        if first is None or bucket > first:
            return False
        if bucket + self.span <= first:
            return True
        slot = -(-(first - bucket) // self.step)
        return mask >> slot == 0

    def _frame(self, key, out: list[tuple[int, np.ndarray | None]]) -> pd.DataFrame:
        frame = pd.DataFrame({k: [v] * len(out) for k, v in zip(self.keys, key, strict=False)})
        frame["_second"] = [b for b, _ in out]
        frame["_removed"] = [v is None for _, v in out]
        for i, c in enumerate(self.cols):
            seen = [[] if v is None else v[~np.isnan(v[:, i]), i] for _, v in out]
            frame[c] = pd.array([math.fsum(x) / len(x) if len(x) else None for x in seen], dtype="Float64")
        return frame


def bucket_changes(
    stream: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    unit: str = "hour",
    seq: str | None = None,
    removed: str | None = None,
    held_days: int | None = None,
    digits: int = 2,
) -> DataFrame:
    """(keys, time, cols, removed): buckets that became complete, changed, or are no longer complete.

    Between rows of one time, `seq` (whole numbers, larger wins) decides inside a batch and the later
    batch between batches. `removed` names a flag of rows to take out. Rows without a time or a key
    of the series are left out.
    """
    if unit not in SPANS:
        raise ValueError(f"buckets in state need one of the units {sorted(SPANS)}, not {unit}")
    if SLOTS[unit][1] != SPANS[unit][0] // SPANS[unit][1]:
        raise ValueError(f"slots of {unit} do not add up")
    series = keys or ["_all"]
    rows = stream.where(F.col(time).isNotNull()).select(
        *(keys or [F.lit(0).alias("_all")]),
        F.unix_seconds(F.col(time).cast("timestamp")).alias("_second"),
        (F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint")).alias("_seq"),
        (F.coalesce(F.col(removed), F.lit(False)) if removed else F.lit(False)).alias("_removed"),
        *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)],
    )
    schema = T.StructType([
        *[rows.schema[k] for k in series], T.StructField("_second", T.LongType()), T.StructField("_removed", T.BooleanType()),
        *[T.StructField(c, T.DoubleType()) for c in cols],
    ])
    out = rows.groupBy(*series).transformWithStateInPandas(BucketState(series, cols, unit, held_days), schema, "Update", "None")
    start = F.timestamp_seconds("_second").cast("timestamp_ntz").alias("time")
    return out.select(*keys, start, *[round_mean(F.col(c), digits).alias(c) for c in cols], F.col("_removed").alias("removed"))


def write_buckets(spark: SparkSession, changes: DataFrame, published: str, checkpoint: str, keys: list[str], cols: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Keeps a month-partitioned table of complete buckets: only the months that a batch names are rewritten.

    A replayed batch overlays the same buckets again and changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn(MONTH, month_key(F.col("time"))).persist()
        try:
            months = sorted(r[0] for r in fresh.select(MONTH).distinct().collect())  # calendar-bounded
            held = set(list_partitions(spark, published, MONTH)) & set(months)
            rows = fresh.where("NOT removed").select(*keys, "time", *cols, MONTH)
            if held:
                old = spark.read.parquet(published).where(F.col(MONTH).isin(months)).select(*keys, "time", *cols, F.col(MONTH).cast("string").alias(MONTH))
                rows = old.join(fresh.select(*keys, "time"), [*keys, "time"], "left_anti").unionByName(rows)
            kept = {r[0] for r in rows.select(MONTH).distinct().collect()}
            if kept:
                rows.repartitionByRange(MONTH, *keys, "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(published)
            drop_partitions(spark, published, sorted(held - kept))
        finally:
            fresh.unpersist()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # the query keeps the settings it starts with
    try:
        writer = changes.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)

