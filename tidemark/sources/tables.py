"""Scans of landed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.timeparts import interval


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Puts `df`, which may read the table at `path`, in its place.

    The rows are written beside the table and swapped in by renames. A write that fails leaves the
    table as it was; a run that stops between the renames leaves the old rows where `restore_table`
    finds them.
    """
    fresh, old = f"{path}._fresh", f"{path}._old"
    restore_table(spark, path)
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(fresh)
    fs, target = _folder(spark, path)
    aside = _folder(spark, old)[1]
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(_folder(spark, fresh)[1], target):
        raise OSError(f"cannot move the new rows of {path} into place; the old ones are in {old}")
    fs.delete(aside, True)


def restore_table(spark: SparkSession, path: str) -> None:
    """Ends a replacement that was cut short: the old rows come back unless the new ones are in place."""
    fs, target = _folder(spark, path)
    old = _folder(spark, f"{path}._old")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        elif not fs.rename(old, target):
            raise OSError(f"cannot restore {path} from {path}._old")


def list_partitions(spark: SparkSession, path: str, name: str) -> list[str]:
    """Sorted partition values from the folder listing; no data file is opened."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(folder))
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{name}="))


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or an empty one of the same schema where nothing has landed yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_last_partitions(spark: SparkSession, path: str, n: int | None = 2, name: str = "month") -> DataFrame:
    """The last `n` existing partitions (None: all), as a static partition filter."""
    table = spark.read.option("mergeSchema", False).parquet(path)
    if n is None:
        return table
    months = list_partitions(spark, path, name)[-n:]
    return table.where(F.col(name).cast("string") >= months[0])


def read_legacy(spark: SparkSession, path: str, schema: StructType | str, recent_only: bool) -> DataFrame:
    """A frozen legacy table; an incremental run does not read it at all."""
    if recent_only:
        return spark.createDataFrame([], schema)
    return read_or_empty(spark, path, schema)


def lookback_scan(df: DataFrame, time: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows of the last `days` days before `as_of` (now, if not given)."""
    anchor = as_of if as_of is not None else F.localtimestamp()
    return df.where(F.col(time) >= anchor - interval(f"{days} days"))
