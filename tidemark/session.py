"""Session defaults and the shared working folder."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.codegen.cache.maxEntries": "1000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Python workers get this package's functions with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

_LOCAL_ROOT: dict[str, str] = {}
_OPEN: list[list[str]] = []


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` keys use _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names its shared folder in spark.checkpoint.dir; `workspace` deletes what a run put
    there. A session without the setting must have a local master, where a temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_ROOT.get("path")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _LOCAL_ROOT["path"] = tempfile.mkdtemp(prefix="tidemark-")
    path = f"{root.rstrip('/')}/tidemark/{purpose}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared folders made inside, also when the run fails.

    What a run returns must be written elsewhere before it ends.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back.

    Cuts the lineage between two jobs: later steps that look at the rows several times scan a
    table, and a lost executor repeats a scan, not the whole history.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
