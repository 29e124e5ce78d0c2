"""Single-value index feeds: parse, cast, fill."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.carry import fill_gaps, tail_rows
from ..operators.clean import project, to_double, with_time_key

# Fixed value: daily rows in twelve years.
CYCLE_ROWS = int(12 * 365.25)

FEEDS = {  # name: (time column, value column, bucket width, rows kept)
    "dst": ("time_tag", "dst", "30 days", None),
    "kp": ("time_tag", "Kp", "30 days", None),
    "ssn": ("Obsdate", "swpc_ssn", "365 days", CYCLE_ROWS),
    "smoothed_ssn": ("time-tag", "predicted_ssn", "3650 days", None),
}


def clean_index(
    df: DataFrame,
    time_col: str,
    value_cols: list[str],
    keys: list[str] | None = None,
    tail: int | None = None,
    width: str = "30 days",
) -> DataFrame:
    """(keys, time, values) with gaps filled by position; the newest `tail` rows if given."""
    keys = keys or []
    rows = to_double(with_time_key(project(df, [*keys, time_col, *value_cols]), time_col), value_cols)
    rows = fill_gaps(rows.select(*keys, "time", *value_cols), keys, "time", value_cols, "full", width)
    return rows if tail is None else tail_rows(rows, tail, "time", keys, width)


def clean_feed(name: str, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    time_col, value, width, tail = FEEDS[name]
    return clean_index(df, time_col, [value], keys, tail, width)
