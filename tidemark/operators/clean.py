"""Row and value repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import null_if_nan, positive_only
from ..functions.timeparts import on_minute, parse_time
from .carry import (
    BUCKET,
    _fill,
    _over_sql,
    _with_previous,
    grid_position,
    in_buckets,
    measured_width,
    spread,
    spread_with_halo,
)
from .quantile import quantiles


def project(df: DataFrame, cols: list[str]) -> DataFrame:
    """Requested columns in the requested order; unknown names are an error that lists them."""
    unknown = sorted(set(cols) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return df.select(*cols)


def minute_boundary(df: DataFrame, time: str) -> DataFrame:
    return df.where(on_minute(F.col(time)))


def to_double(df: DataFrame, cols: list[str], strict: bool = True) -> DataFrame:
    """Casts to DOUBLE with NaN turned into NULL; a bad string raises unless strict is off."""
    cast = lambda c: F.col(c).cast("double") if strict else F.col(c).try_cast("double")
    return df.withColumns({c: null_if_nan(cast(c)) for c in cols})


def with_time_key(df: DataFrame, text: str, out: str = "time", strict: bool = True) -> DataFrame:
    """Replaces a text time column by a TIMESTAMP_NTZ column in first place.

    A text that is no time raises unless strict is off; `bad_times` counts what that would lose.
    """
    rest = [c for c in df.columns if c != text]
    return df.select(parse_time(F.col(text), strict).alias(out), *rest)


def mask_invalid(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: positive_only(F.col(c)) for c in cols})


def mask_outliers(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    q: float = 0.97,
    width: str | None = "1 day",
    step: str | None = None,
    thresholds: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """NULL where the rate of change exceeds that column's q-quantile over the series.

    `step` says the rows lie on a regular grid of that step, which saves the pass that carries
    values across buckets. `thresholds` (keys + one column per value column) replaces the measured
    quantiles, for incremental runs that must use the published ones.
    """
    width = width or measured_width(df, keys, time)
    return _mask_outliers(df, keys, time, cols, q, width, step, thresholds, approx).drop(BUCKET)


def _mask_outliers(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    q: float,
    width: str,
    step: str | None,
    thresholds: DataFrame | None,
    approx: bool,
) -> DataFrame:
    """The masked rows with their bucket, clustered by (key, bucket)."""
    given = [f"`{c}`" for c in df.columns]
    if step:
        parts = spread_with_halo(df, keys, time, width, step)
        over = _over_sql(keys, [time])
        before = parts.selectExpr("*", *[f"lag(`{c}`) {over} AS `_p_{c}`" for c in cols]).where("_home")
    else:
        parts = spread(df, keys, time, width)
        before = _with_previous(parts, keys, time, cols, "_p_")
    moved = before.selectExpr(*given, BUCKET, *[f"abs(`{c}` - `_p_{c}`) AS `_r_{c}`" for c in cols])
    # One row per (key, bucket), so that per-key values reach the rows over a well-spread key.
    spine = in_buckets(df, keys, time, width).select(*keys, BUCKET).distinct() if keys else None
    if thresholds is None:
        measured = moved.selectExpr(*[f"`{k}`" for k in keys], BUCKET, *[f"`_r_{c}` AS `{c}`" for c in cols])
        thresholds = quantiles(measured, keys, cols, q, approx, spine)
    if keys:
        limits = thresholds.selectExpr(*[f"`{k}`" for k in keys], *[f"`{c}` AS `_q_{c}`" for c in cols])
        limited = moved.join(spine.join(limits, keys), [*keys, BUCKET], "left")
    else:
        row = thresholds.select(F.struct(*cols).alias("q")).scalar()
        limited = moved.withColumn("_q", row).selectExpr("*", *[f"_q.`{c}` AS `_q_{c}`" for c in cols])

    def kept(c: str) -> str:
        steady = f"`_r_{c}` IS NULL OR `_q_{c}` IS NULL OR `_r_{c}` <= `_q_{c}`"
        return f"CASE WHEN {steady} THEN `{c}` END AS `{c}`" if c in cols else f"`{c}`"

    return limited.selectExpr(*[kept(c) for c in df.columns], BUCKET)


def mask_and_fill(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    q: float = 0.97,
    width: str | None = "1 day",
    step: str | None = None,
    thresholds: DataFrame | None = None,
    approx: bool = False,
) -> DataFrame:
    """Outlier mask followed by the full gap fill, on one exchange of the rows."""
    width = width or measured_width(df, keys, time)
    masked = _mask_outliers(df, keys, time, cols, q, width, step, thresholds, approx)
    position = grid_position(time, step) if step else None
    return _fill(masked, keys, time, cols, "full", position).drop(BUCKET)


def drop_incomplete(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols)
