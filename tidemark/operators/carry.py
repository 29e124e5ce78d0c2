"""Ordered, whole-series windows without a whole series in one task.

A series is cut into (key, time bucket) groups. Each group is windowed on its own; a one-row
summary per group carries what neighbours need across the cut. Only the summary is windowed per
key, and its length is the calendar span over the bucket width, whatever the row count. A group
holds at most width / resolution rows because (key, time) is unique, so one hot series spreads
over many tasks. Where the resolution of a feed is not known, width=None measures the densest
bucket and picks a width that keeps every group small.

Keys and time are the primary key of a series: both are non-null and together unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeparts import bucket_number, epoch_seconds, seconds_of

BUCKET = "_bucket"
WIDTH_LADDER = ("365 days", "30 days", "1 day", "1 hour", "1 minute", "1 second")


def spread(df: DataFrame, keys: list[str], time: str, width: str) -> DataFrame:
    """One exchange on (key, bucket), shared by the summary and the detail branch.

    Both branches are joined on (key, bucket). Saying up front that those are not NULL keeps the
    optimizer from adding that filter to one branch only, which would stop the sharing.
    """
    return in_buckets(df, keys, time, width).repartition(*keys, BUCKET)


def in_buckets(df: DataFrame, keys: list[str], time: str, width: str) -> DataFrame:
    return _present(df.withColumn(BUCKET, bucket_number(F.col(time), width)), keys)


def _present(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, BUCKET]))


def measured_width(df: DataFrame, keys: list[str], time: str, max_rows: int = 1_000_000) -> str:
    """Widest ladder step at which no (key, bucket) group exceeds `max_rows`.

    Counts at the finest step combine map-side and roll up, so a hot key costs no more than its
    distinct seconds. Runs one job; use it when the resolution of a feed is not known.
    """
    counts = df.groupBy(*keys, bucket_number(F.col(time), "1 second").alias("_s")).agg(
        F.count("*").alias("_n")
    )
    worst = None
    for step in WIDTH_LADDER:
        size = seconds_of(step)
        level = counts.groupBy(*keys, F.floor(F.col("_s") / size).alias("_b")).agg(F.sum("_n").alias("_n"))
        row = level.agg(F.lit(size).alias("size"), F.max("_n").alias("rows"))
        worst = row if worst is None else worst.unionByName(row)
    fits = worst.where((F.col("rows") <= max_rows) | F.col("rows").isNull()).agg(F.max("size")).first()[0]
    by_size = {seconds_of(step): step for step in WIDTH_LADDER}
    return by_size.get(fits, WIDTH_LADDER[-1])


def _inside(keys: list[str], *order: Column | str):
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def _across(keys: list[str], newest_first: bool = False):
    order = F.col(BUCKET).desc() if newest_first else F.col(BUCKET).asc()
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _over_sql(keys: list[str], order: list[str]) -> str:
    part = ", ".join(f"`{k}`" for k in [*keys, BUCKET])
    return f"OVER (PARTITION BY {part} ORDER BY {', '.join(f'`{o}`' for o in order)})"


def positions(
    df: DataFrame, keys: list[str], time: str, width: str | None = "1 day", out: str = "pos", step: str | None = None
) -> DataFrame:
    """Adds the row position inside each series: dense and from 0, or on a regular grid its step number."""
    if step:
        return _present(df.withColumn(BUCKET, F.lit(0)), [*keys, time]).drop(BUCKET).withColumn(out, grid_position(time, step))
    rows = in_buckets(df, keys, time, width or measured_width(df, keys, time))
    parts = rows.repartition(*keys, BUCKET)
    base = (
        rows.groupBy(*keys, BUCKET)
        .agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(_across(keys)), F.lit(0)))
        .drop("_n")
    )
    return (
        parts.join(base, [*keys, BUCKET])
        .withColumn(out, F.col("_base") + F.row_number().over(_inside(keys, time)) - 1)
        .drop("_base", BUCKET)
    )


def grid_position(time: str, step: str) -> Column:
    """Row position on a regular grid, straight from the time."""
    return F.floor(epoch_seconds(F.col(time)) / seconds_of(step)).cast("bigint")


def spread_with_halo(df: DataFrame, keys: list[str], time: str, width: str, step: str) -> DataFrame:
    """spread() for a regular grid, the last row of each bucket copied to the start of the next.

    `_home` tells a bucket's own rows from the copy, so a lag needs no summary.
    """
    home = bucket_number(F.col(time), width)
    last = home != F.floor((epoch_seconds(F.col(time)) + seconds_of(step)) / seconds_of(width))
    targets = F.when(last, F.array(home, home + 1)).otherwise(F.array(home))
    rows = df.withColumn(BUCKET, F.explode(targets))
    return _present(rows.withColumn("_home", F.col(BUCKET) == home), keys).repartition(*keys, BUCKET)


def with_previous(
    df: DataFrame, keys: list[str], time: str, cols: list[str], width: str | None = "1 day", prefix: str = "prev_"
) -> DataFrame:
    """Adds the previous row's value of each column (NULL where that value is NULL)."""
    parts = spread(df, keys, time, width or measured_width(df, keys, time))
    return _with_previous(parts, keys, time, cols, prefix).drop(BUCKET)


def _with_previous(parts: DataFrame, keys: list[str], time: str, cols: list[str], prefix: str) -> DataFrame:
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    tails = parts.groupBy(*keys, BUCKET).agg(*[F.expr(f"max_by(`{c}`, `{time}`) AS `_t_{c}`") for c in cols])
    carried = tails.selectExpr(
        *[f"`{k}`" for k in keys], BUCKET, *[f"lag(`_t_{c}`) OVER ({part}ORDER BY {BUCKET}) AS `_c_{c}`" for c in cols]
    )
    over = _over_sql(keys, [time])
    joined = parts.join(carried, [*keys, BUCKET]).selectExpr("*", f"row_number() {over} = 1 AS _first")
    before = [f"CASE WHEN _first THEN `_c_{c}` ELSE lag(`{c}`) {over} END AS `{prefix}{c}`" for c in cols]
    return joined.selectExpr(*[f"`{c}`" for c in parts.columns], *before)


def rate_of_change(
    df: DataFrame, keys: list[str], time: str, cols: list[str], width: str | None = "1 day", suffix: str = "_roc"
) -> DataFrame:
    """Adds abs(x - previous row's x); NULL when either is NULL."""
    out = with_previous(df, keys, time, cols, width, prefix="_p_")
    return out.withColumns({f"{c}{suffix}": F.abs(F.col(c) - F.col(f"_p_{c}")) for c in cols}).drop(
        *[f"_p_{c}" for c in cols]
    )


def fill_gaps(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    how: str = "full",
    width: str | None = "1 day",
    position: Column | None = None,
    tie_break: str | None = None,
) -> DataFrame:
    """Fills NULLs from the nearest known neighbours of the same series.

    how: 'linear' draws a straight line by row position (not elapsed time) and repeats the last
    value past the end; 'forward' and 'backward' repeat the neighbour; 'full' is linear and then
    backward for the leading NULLs. `position` replaces the counted row position when the rows lie
    on a regular grid, which saves the counting pass.
    """
    parts = spread(df, keys, time, width or measured_width(df, keys, time))
    return _fill(parts, keys, time, cols, how, position, tie_break).drop(BUCKET)


def _fill(
    parts: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    how: str,
    position: Column | None = None,
    tie_break: str | None = None,
) -> DataFrame:
    order = [time] + ([tie_break] if tie_break else [])
    counted = position is None
    here = F.row_number().over(_inside(keys, *order)).cast("bigint") if counted else position
    placed = parts.withColumn("_lp", here)

    # Per bucket: the last and the first known value of each column and where they are.
    looks_back, looks_on = how != "backward", how != "forward"
    aggs, carried = [F.count("*").alias("_n")], []
    ahead, behind = _across_sql(keys, "DESC"), _across_sql(keys, "ASC")
    for c in cols:
        known = f"CASE WHEN `{c}` IS NOT NULL THEN _lp END"
        if looks_back:
            aggs += [F.expr(f"max_by(`{c}`, {known}) AS `_lv_{c}`"), F.expr(f"max({known}) AS `_lq_{c}`")]
            carried.append(f"last({_point(f'_lq_{c}', f'_lv_{c}')}, true) {behind} AS `_cp_{c}`")
        if looks_on:
            aggs += [F.expr(f"min_by(`{c}`, {known}) AS `_fv_{c}`"), F.expr(f"min({known}) AS `_fq_{c}`")]
            carried.append(f"last({_point(f'_fq_{c}', f'_fv_{c}')}, true) {ahead} AS `_cn_{c}`")
    ends = placed.groupBy(*keys, BUCKET).agg(*aggs)
    base = f"coalesce(sum(_n) {behind}, 0)" if counted else "0L"
    ends = ends.selectExpr("*", f"{base} AS _base").selectExpr(*[f"`{k}`" for k in keys], BUCKET, "_base", *carried)

    # Nearest known points on both sides: the row's own, its bucket's, else the carried one.
    over = _over_sql(keys, order)
    points = [f"{_point('_lp', c, c)} AS `_m_{c}`" for c in cols]
    joined = placed.join(ends, [*keys, BUCKET]).selectExpr("*", "_base + _lp AS _p", *points)
    around, filled = [], {}
    for c in cols:
        if looks_back:
            around.append(f"coalesce(`_m_{c}`, lag(`_m_{c}`) IGNORE NULLS {over}, `_cp_{c}`) AS `_b_{c}`")
        if looks_on:
            around.append(f"coalesce(`_m_{c}`, lead(`_m_{c}`) IGNORE NULLS {over}, `_cn_{c}`) AS `_a_{c}`")
        before, after = f"`_b_{c}`", f"`_a_{c}`"
        line = f"({after}.v - {before}.v) / ({after}.p - {before}.p) * (_p - {before}.p) + {before}.v"
        drawn = f"CASE WHEN `{c}` IS NOT NULL THEN `{c}` WHEN {after} IS NULL THEN {before}.v ELSE {line} END"
        filled[c] = {
            "forward": f"{before}.v",
            "backward": f"{after}.v",
            "linear": drawn,
            "full": f"coalesce({drawn}, {after}.v)",
        }[how]
    return joined.selectExpr("*", *around).selectExpr(
        *[f"{filled[c]} AS `{c}`" if c in filled else f"`{c}`" for c in parts.columns]
    )


def _point(position: str, value: str, known: str | None = None) -> str:
    return f"CASE WHEN `{known or position}` IS NOT NULL THEN struct(_base + `{position}` AS p, `{value}` AS v) END"


def _across_sql(keys: list[str], direction: str) -> str:
    part = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} " if keys else ""
    return f"OVER ({part}ORDER BY {BUCKET} {direction} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def tail_rows(
    df: DataFrame, n: int, time: str, keys: list[str] | None = None, width: str | None = "30 days"
) -> DataFrame:
    """The newest `n` rows of each series, by row count; rows of one time in no fixed order.

    Without keys Spark's top-n does it. With keys, bucket counts say which buckets lie wholly among
    the newest `n` rows; only the one the limit falls into is ranked, inside its own group.
    """
    if not keys:
        return df.orderBy(F.col(time).desc()).limit(n)
    width = width or measured_width(df, keys, time)
    marked = df.withColumn(BUCKET, bucket_number(F.col(time), width))
    counts = marked.groupBy(*keys, BUCKET).agg(F.count("*").alias("_n"))
    newer = F.coalesce(F.sum("_n").over(_across(keys, newest_first=True)), F.lit(0))
    needed = counts.withColumn("_newer", newer).where(F.col("_newer") < n)
    rows = marked.join(needed, [*keys, BUCKET])
    whole = rows.where(F.col("_newer") + F.col("_n") <= n)
    rank = F.row_number().over(_inside(keys, F.col(time).desc()))
    cut = rows.where(F.col("_newer") + F.col("_n") > n).withColumn("_rank", rank).where(F.col("_newer") + F.col("_rank") <= n)
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def latest_row(df: DataFrame, time: str, keys: list[str] | None = None) -> DataFrame:
    """The newest row of each series as one hash aggregation over its columns."""
    keys = keys or []
    rest = [c for c in df.columns if c not in keys and c != time]
    out = df.groupBy(*keys).agg(F.max(time).alias(time), *[F.max_by(c, time).alias(c) for c in rest])
    return out.where(F.col(time).isNotNull()).select(*df.columns)
