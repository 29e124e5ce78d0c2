"""Which documents of a feed have been dealt with, so that a run reads only what came since.

A ledger is a table of (feed, path, written, state, reason, at). A document is known by its path and
the time it was written: one that is written again counts as new. Entries are appended after the
rows of a delivery are in their table. A run that fails in between reads the same documents again,
which changes nothing, as a merge of records already merged does not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .tables import exists, read_or_empty

SCHEMA = "feed string, path string, written timestamp, state string, reason string, at timestamp_ntz"
LANDED, REFUSED, PASSED = "landed", "refused", "passed"
#: Files of a ledger from which it is rewritten as one.
_FILES = 200


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, written, file): the documents of a folder, from its listing; none is opened."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("written"), F.col("_metadata.file_path").alias("file"))


def pending(spark: SparkSession, folder: str, ledger: str) -> list[Row]:
    """(path, written, file) of the documents that the ledger does not have, by time written, then path.

    As long as one delivery; Spark's own listing of the folder, which the driver holds too, is longer.
    """
    if not exists(spark, folder):
        return []
    known = read_or_empty(spark, ledger, SCHEMA).select("path", "written")
    return sorted(listed(spark, folder).join(known, ["path", "written"], "left_anti").collect(), key=lambda r: (r.written, r.path))


def read_pending(spark: SparkSession, files: list[Row]) -> DataFrame:
    """(payload, document, written): the given documents, numbered in their order; `written` in microseconds."""
    plain = [re.sub(r"([\[\]{}*?,\\])", r"\\\1", f.path) for f in files]
    texts = spark.read.text(plain, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"))
    numbers = spark.createDataFrame([(f.file, i) for i, f in enumerate(files)], "file string, document bigint")
    times = spark.createDataFrame([(f.file, f.written) for f in files], "file string, written timestamp")
    return texts.join(numbers.join(times, "file"), "file").select("payload", "document", F.unix_micros("written").alias("written"))


def record(spark: SparkSession, ledger: str, feed: str, entries: list[tuple[Row, str, str | None]], at: Column) -> None:
    """Appends (document, state, reason) entries; a ledger of many small files becomes one."""
    if not entries:
        return
    rows = spark.createDataFrame([(feed, f.path, f.written, state, reason) for f, state, reason in entries], "feed string, path string, written timestamp, state string, reason string")
    rows.withColumn("at", at.cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(ledger)
    table = spark.read.schema(SCHEMA).parquet(ledger)
    if len(table.inputFiles()) > _FILES:
        from .tables import replace_table

        replace_table(spark, table.repartitionByRange("feed", "path"), ledger)


def landed_feeds(spark: SparkSession, ledger: str) -> set[str]:
    """Feeds with a landed document; as many names as there are feeds."""
    return {r[0] for r in read_or_empty(spark, ledger, SCHEMA).where(F.col("state") == LANDED).select("feed").distinct().collect()}
