"""Backward as-of join through the carry kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carry import BUCKET, _across, fill_gaps, in_buckets


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    width: str | None = "1 day",
    unique_left: bool = False,
) -> DataFrame:
    """Adds to each left row the newest right values at or before its time.

    Left rows before the first right value are dropped. A left side with repeated (key, time) is
    reduced to its distinct times first, so the ordered part never sees a hot timestamp, and the
    answer is joined back on equality, which the adaptive skew join can split.

    A right side without any of the keys holds for every series: it is then carried once over the
    distinct times, and each series picks up its times by equality.
    """
    if keys and not set(keys) & set(right.columns):
        times = left.select(time).distinct()
        return left.join(asof_join(times, right, [], time, cols, width, unique_left=True), time).select(*left.columns, *cols)
    spots = left if unique_left else left.select(*keys, time).distinct()
    extra = [c for c in spots.columns if c not in keys and c != time]
    right_rows = right.select(*keys, time, *cols, F.lit(0).alias("_side")).where(
        F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    )
    left_rows = spots.withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in cols}).withColumn(
        "_side", F.lit(1)
    )
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    carried = fill_gaps(both, keys, time, cols, how="forward", width=width, tie_break="_side")
    answered = carried.where((F.col("_side") == 1) & F.col(cols[0]).isNotNull())
    for c in cols[1:]:
        answered = answered.where(F.col(c).isNotNull())
    if unique_left:
        return answered.select(*keys, time, *extra, *cols)
    return left.join(answered.select(*keys, time, *cols), [*keys, time])


def asof_slow(left: DataFrame, right: DataFrame, keys: list[str], time: str, col: str, width: str = "1 day", most: int = 64) -> DataFrame:
    """The same for a right side that changes seldom against the width: `left` is not moved by order.

    Per (key, bucket) there is one small row: the value carried to the bucket's start and the changes
    inside it. That table, as long as the calendar, is joined on (key, bucket), and each row picks the
    last change up to its time. Buckets with over `most` changes are kept out of it: their left rows
    are answered by order, so no row holds or searches a longer array. Of several values at one time
    the largest counts. A right side without the keys holds for every series.
    """
    shared = [k for k in keys if k in right.columns]
    spot = [*shared, BUCKET]
    known = right.select(*shared, F.col(time).alias("_at"), F.col(col).alias("_v")).where("_at IS NOT NULL AND _v IS NOT NULL")
    changes = in_buckets(known.groupBy(*shared, "_at").agg(F.max("_v").alias("_v")), shared, "_at", width)
    rows = in_buckets(left, keys, time, width)
    ends = changes.groupBy(*spot).agg(F.count("*").alias("_n"), F.max_by("_v", "_at").alias("_last"))
    begins = rows.select(*spot).distinct().join(ends, spot, "full")
    begins = begins.withColumn("_carried", F.last("_last", ignorenulls=True).over(_across(shared)))
    seldom = changes.join(ends.where(F.col("_n") <= most).select(*spot), spot, "left_semi")
    steps = seldom.groupBy(*spot).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_steps"))  # the changes of one bucket
    held = begins.where(F.coalesce("_n", F.lit(0)) <= most).select(*spot, "_carried").join(steps, spot, "left")
    held = held.where("_carried IS NOT NULL OR _steps IS NOT NULL")
    past = F.filter("_steps", lambda s: s["_at"] <= F.col(time))
    found = F.when(F.size(past) > 0, F.element_at(past, -1)["_v"]).otherwise(F.col("_carried"))
    picked = rows.join(held, spot).withColumn(col, found).where(F.col(col).isNotNull()).select(*left.columns, col)

    crowded = rows.join(ends.where(F.col("_n") > most).select(*spot), spot, "left_semi")
    newest = changes.select(*shared, F.col("_at").alias(time), F.col("_v").alias(col))
    ordered = asof_join(crowded.select(*shared, time).distinct(), newest, shared, time, [col], width, unique_left=True)
    return picked.unionByName(crowded.join(ordered, [*shared, time]).select(*left.columns, col))
