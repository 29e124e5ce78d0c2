"""Outlier thresholds over a whole history, from counts that add up month by month.

Under a root folder that all runs share lie three tables, partitioned by month: `values` (the rates
of change of each series and column, each distinct one counted), `bins` (their counts by the bins of
`quantile`) and `edges` (each series' last row of the month, which the next month's first rate
needs). A run replaces the months it has read. The threshold then needs the sums of the bins and,
of the values, only those of the one or two bins that hold its rank: files are sorted by column and
bin, so the others are skipped. It is the exact quantile over all months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import interval, month_key
from ..session import staged
from ..sources.tables import list_partitions
from .carry import _over_sql, _with_previous, spread, spread_with_halo
from .publish import MONTH
from .quantile import _bin, _long, _names, _targets, resolve

#: Marks the rows that a run takes over from the month before those it has read.
EDGE = "_edge"


def _replace(df: DataFrame, path: str, *order: str) -> None:
    ordered = df.repartitionByRange(MONTH, *order).sortWithinPartitions(MONTH, *order)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def _edges(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], time: str, cols: list[str], step: str | None) -> DataFrame | None:
    """For each series of `rows`, its last row of the months before; on a grid only if it is the step before."""
    held = list_partitions(spark, f"{root}/edges", MONTH)
    if not held:
        return None
    known = spark.read.parquet(f"{root}/edges").select(*keys, F.col(time).alias("_t"), *cols)
    if keys:
        known = known.join(rows.groupBy(*keys).agg(F.min(time).alias("_first")), keys)
    else:
        known = known.withColumn("_first", rows.agg(F.min(time)).scalar())
    earlier = known.where(F.col("_t") < F.col("_first"))
    if step:
        earlier = earlier.where(F.col("_t") + interval(step) == F.col("_first"))
    last = earlier.groupBy(*keys).agg(F.max_by(F.struct(F.col("_t").alias(time), *cols), "_t").alias("_r"))
    return last.select(*keys, "_r.*").where(F.col(time).isNotNull())


def update_rates(
    spark: SparkSession, root: str, rows: DataFrame, keys: list[str], time: str, cols: list[str], width: str = "1 day", step: str | None = None
) -> DataFrame:
    """Replaces the months of `rows` in the tables under `root`; the rows, led by the edges before them.

    `rows` hold whole months, as a scan of month partitions gives them, and are read several times:
    stage them. `step` says that they lie on a regular grid. Repeating an update changes nothing.
    """
    rows = rows.select(*keys, time, *cols)
    edges = _edges(spark, root, rows, keys, time, cols, step)
    led = rows.withColumn(EDGE, F.lit(False))
    if edges is not None:
        # Few rows, one a series; the months they come from are replaced below.
        led = led.unionByName(staged(edges, "edges").withColumn(EDGE, F.lit(True)))
    if step:
        parts = spread_with_halo(led, keys, time, width, step)
        before = parts.selectExpr("*", *[f"lag(`{c}`) {_over_sql(keys, [time])} AS `_p_{c}`" for c in cols]).where("_home")
    else:
        before = _with_previous(spread(led, keys, time, width), keys, time, cols, "_p_")
    moved = before.where(f"NOT {EDGE}").selectExpr(*_names(keys), f"`{time}`", *[f"abs(`{c}` - `_p_{c}`) AS `_r_{c}`" for c in cols])
    moved = moved.withColumn(MONTH, month_key(F.col(time)))
    group = [*keys, "_col"]
    values = _long(moved, [*keys, MONTH], {c: f"`_r_{c}`" for c in cols}).groupBy(*group, MONTH, "_x").agg(F.count("*").alias("_n"))
    _replace(values.selectExpr("*", f"{_bin('_x')} AS _bin"), f"{root}/values", "_col", "_bin", *keys)
    months = [m for (m,) in rows.select(month_key(F.col(time))).distinct().collect()]  # calendar-bounded
    stored = spark.read.parquet(f"{root}/values").where(F.col(MONTH).isin(months)).withColumn(MONTH, F.col(MONTH).cast("string"))
    _replace(stored.groupBy(*group, MONTH, "_bin").agg(F.sum("_n").alias("_n")), f"{root}/bins", "_col", "_bin")
    ends = rows.withColumn(MONTH, month_key(F.col(time))).groupBy(*keys, MONTH).agg(F.max_by(F.struct(time, *cols), time).alias("_r"))
    _replace(ends.select(*keys, MONTH, "_r.*"), f"{root}/edges", *(keys or [time]))
    return led


def published_thresholds(spark: SparkSession, root: str, keys: list[str], cols: list[str], q: float = 0.97) -> DataFrame:
    """One row per key with the q-quantile of each column's rates over all months, exactly."""
    group = [*keys, "_col"]
    bins = spark.read.parquet(f"{root}/bins").where(F.col("_col").isin(cols)).groupBy(*group, "_bin").agg(F.sum("_n").alias("_n"))
    targets = staged(_targets(bins, group, q), "targets")
    # The scale has some ten thousand bins at most, however many series share it.
    wanted: dict[str, list[int]] = {}
    for column, number in targets.select("_col", "_bin").distinct().collect():
        wanted.setdefault(column, []).append(number)
    here = F.lit(False)
    for column, numbers in wanted.items():
        here = here | ((F.col("_col") == column) & F.col("_bin").isin(numbers))
    counted = spark.read.parquet(f"{root}/values").where(here).groupBy(*group, "_x", "_bin").agg(F.sum("_n").alias("_n"))
    tall = resolve(counted, targets, group)
    return tall.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN _col = '{c}' THEN _q END) AS `{c}`") for c in cols])
