"""Reading a table's changes in polls that remember how far they came.

A poll's range (after `since`, up to `upto`) is written down before its changes are applied, and
marked done afterwards, in a small log beside the derived table. A poll that fails is repeated over
the same range under the same number, so what it derives is replaced and not added again; rows
written meanwhile belong to the next poll. Nothing is applied twice, nothing is left out.
"""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import interval
from ..sources.tables import read_or_empty, replace_table
from .publish import retention_trim

SCHEMA = "name string, poll bigint, since timestamp_ntz, upto timestamp_ntz, done boolean"
#: Files of a log from which only each reader's last entries are kept.
_FILES = 100


@dataclasses.dataclass(frozen=True)
class Poll:
    """One range of changes of a table: after `since` (None: from the beginning), up to `upto`."""

    number: int
    since: datetime.datetime | None
    upto: datetime.datetime


def _write(spark: SparkSession, log: str, name: str, poll: Poll, done: bool) -> None:
    row = spark.createDataFrame([(name, poll.number, poll.since, poll.upto, done)], SCHEMA)
    row.coalesce(1).write.mode("append").parquet(log)
    table = spark.read.schema(SCHEMA).parquet(log)
    if len(table.inputFiles()) > _FILES:
        last = table.groupBy("name").agg(F.max("poll").alias("poll"))
        replace_table(spark, table.join(last, ["name", "poll"], "left_semi").select(*table.columns).coalesce(1), log)


def last_poll(spark: SparkSession, log: str, name: str) -> tuple[Poll, bool] | None:
    """A reader's newest poll and whether it was done."""
    rows = read_or_empty(spark, log, SCHEMA).where(F.col("name") == name)
    row = rows.groupBy("poll").agg(F.max("since").alias("since"), F.max("upto").alias("upto"), F.bool_or("done").alias("done")).orderBy(F.desc("poll")).first()
    return None if row is None else (Poll(row.poll, row.since, row.upto), row.done)


def next_poll(spark: SparkSession, log: str, name: str, table: DataFrame, lag: str | None = None, as_of: Column | None = None) -> Poll | None:
    """The poll to run now: the last one if it was not done, else one up to the newest change, or None.

    With `lag`, changes written less than that before `as_of` (the clock) wait for the next poll, for
    writers whose rows become visible later than their stamps say.
    """
    before = last_poll(spark, log, name)
    if before is not None and not before[1]:
        return before[0]
    since = before[0].upto if before is not None else None
    rows = table if since is None else table.where(F.col("updated_at") > F.lit(since).cast("timestamp_ntz"))
    if lag is not None:
        rows = rows.where(F.col("updated_at") <= (as_of if as_of is not None else F.localtimestamp()) - interval(lag))
    upto = rows.agg(F.max("updated_at")).first()[0]
    if upto is None:
        return None
    poll = Poll(before[0].number + 1 if before is not None else 0, since, upto)
    _write(spark, log, name, poll, False)
    return poll


def poll_rows(table: DataFrame, poll: Poll, time: str = "time", held_days: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """The rows of a poll, inside each series' held window."""
    rows = retention_trim(table, time, f"{held_days} days" if held_days else None, keys)
    rows = rows.where(F.col("updated_at") <= F.lit(poll.upto).cast("timestamp_ntz"))
    return rows if poll.since is None else rows.where(F.col("updated_at") > F.lit(poll.since).cast("timestamp_ntz"))


def run_poll(
    spark: SparkSession,
    path: str,
    log: str,
    name: str,
    apply: Callable[[DataFrame, Poll], None],
    time: str = "time",
    held_days: int | None = None,
    keys: list[str] | None = None,
    lag: str | None = None,
    as_of: Column | None = None,
) -> Poll | None:
    """Applies what changed in the table at `path` since the last poll of `name`; None if nothing did.

    `apply` gets the rows and the poll, and must give the same result when it gets the same poll
    again, as recomputing buckets or overwriting the folder of the poll's number does.
    """
    from ..sources.tables import exists

    if not exists(spark, path):
        return None
    table = spark.read.parquet(path)
    poll = next_poll(spark, log, name, table, lag, as_of)
    if poll is not None:
        apply(poll_rows(table, poll, time, held_days, keys), poll)
        _write(spark, log, name, poll, True)
    return poll
