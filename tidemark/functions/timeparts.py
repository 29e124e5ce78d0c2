"""Time arithmetic on TIMESTAMP_NTZ that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds_of(width: str) -> int:
    """'1 day' -> 86400; calendar units (month, year) are not fixed widths."""
    amount, unit = width.split()
    return int(amount) * SECONDS[unit.rstrip("s")]


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of the wall-clock value."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_millis(ts: Column) -> Column:
    parts = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("bigint")
    return epoch_seconds(ts) * 1000 + F.pmod(parts, F.lit(1000))


def from_epoch_seconds(seconds: Column) -> Column:
    day = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.date_from_unix_date(day).cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, rest)


def bucket_number(ts: Column, width: str) -> Column:
    return F.floor(epoch_seconds(ts) / seconds_of(width)).cast("bigint")


def floor_time(ts: Column, unit: str) -> Column:
    """Start of the hour, day, week (Monday), month or year holding `ts`."""
    day = ts.cast("date")
    if unit == "hour":
        return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))
    if unit == "day":
        return day.cast("timestamp_ntz")
    if unit == "week":
        # Day 0 was a Thursday.
        monday = F.floor((F.unix_date(day) + 3) / 7) * 7 - 3
        return F.date_from_unix_date(monday.cast("int")).cast("timestamp_ntz")
    return F.trunc(day, unit).cast("timestamp_ntz")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parse_time(text: Column, strict: bool = True) -> Column:
    """ISO date-time, date-only or year-month text. Anything else raises, or becomes NULL if not strict."""
    plain = F.rtrim(F.trim(text), F.lit("Z"))
    lenient = plain.try_cast("timestamp_ntz")
    if not strict:
        return lenient
    bad = F.raise_error(F.concat(F.lit("not a time: "), F.substring(text, 1, 40))).cast("timestamp_ntz")
    return F.when(text.isNotNull() & lenient.isNull(), bad).otherwise(lenient)


def bad_times(df: DataFrame, text: str) -> DataFrame:
    """One row: how many texts a lenient parse would turn into NULL."""
    lost = F.col(text).isNotNull() & parse_time(F.col(text), strict=False).isNull()
    return df.agg(F.count_if(lost).alias("bad_times"))


def interval(text: str) -> Column:
    """'24 hours', '1 month' ... as an interval; months are calendar-aware and clamp the day."""
    return F.expr(f"INTERVAL {text}")


def on_minute(ts: Column) -> Column:
    return F.second(ts) == 0
