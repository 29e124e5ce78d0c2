"""Which of several sources supplies a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import lookup

# Smaller is preferred.
SOURCE_PRIORITY = {"SOLAR1": 0, "IMAP": 1, "ACE": 2, "DSCOVR": 3}
UNKNOWN_PRIORITY = 999


def source_rank(source: Column, priority: dict[str, int] = SOURCE_PRIORITY) -> Column:
    """A BIGINT order: known sources by priority, unknown ones after them in a fixed order.

    One long, rather than (priority, name), keeps the aggregation buffers fixed-width, so the
    selection runs as a hash aggregation.
    """
    known = lookup(priority, source, UNKNOWN_PRIORITY).cast("bigint")
    fixed = F.shiftrightunsigned(F.xxhash64(source), 2)
    return F.when(known < UNKNOWN_PRIORITY, known).otherwise(F.lit(UNKNOWN_PRIORITY) + fixed)


def first_valid_by_priority(
    df: DataFrame, keys: list[str], cols: list[str], rank: Column
) -> DataFrame:
    """Per group and per column, the first non-NULL value in rank order; one row can mix sources."""
    ranked = df.withColumn("_rank", rank)
    return ranked.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in cols]
    )


def select_source(
    df: DataFrame,
    keys: list[str],
    cols: list[str],
    source: str = "source",
    active: str = "active",
    priority: dict[str, int] = SOURCE_PRIORITY,
) -> DataFrame:
    """One row per group: active sources first, inactive ones when the active data is unusable.

    The active candidate gives way to the inactive one only if it is NULL in every column and some
    single inactive row is complete; a group without any active row always uses the inactive one.
    A row whose active flag is missing counts as inactive.
    """
    ranked = df.withColumn("_rank", source_rank(F.col(source), priority)).withColumn(active, F.coalesce(active, F.lit(False)))
    complete = " AND ".join(f"`{c}` IS NOT NULL" for c in cols)
    aggs = [
        F.expr(f"bool_or(`{active}`) AS _any_active"),
        F.expr(f"bool_or(NOT `{active}` AND {complete}) AS _inactive_complete"),
    ]
    for c in cols:
        known = f"`{c}` IS NOT NULL THEN _rank END"
        aggs.append(F.expr(f"min_by(`{c}`, CASE WHEN `{active}` AND {known}) AS `_a_{c}`"))
        aggs.append(F.expr(f"min_by(`{c}`, CASE WHEN NOT `{active}` AND {known}) AS `_i_{c}`"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    active_empty = " AND ".join(f"`_a_{c}` IS NULL" for c in cols)
    swap = f"NOT _any_active OR ({active_empty} AND _inactive_complete)"
    return picked.selectExpr(
        *[f"`{k}`" for k in keys], *[f"CASE WHEN {swap} THEN `_i_{c}` ELSE `_a_{c}` END AS `{c}`" for c in cols]
    )
