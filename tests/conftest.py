import pathlib
import sys
import tempfile

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory(prefix="tidemark-tests-") as shared:
        session = build_session(
            "tests",
            "local[4]",
            spark_sql_shuffle_partitions="4",
            spark_ui_enabled="false",
            spark_driver_memory="8g",
            spark_checkpoint_dir=shared,
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture
def frame(spark):
    """frame(ddl, rows): time columns may be given as ISO text."""

    def build(ddl, rows):
        names = [part.split()[0].strip("`") for part in ddl.split(",")]
        texty = ddl.replace("TIMESTAMP_NTZ", "STRING")
        df = spark.createDataFrame(rows, texty)
        for name, part in zip(names, ddl.split(",")):
            if "TIMESTAMP_NTZ" in part:
                df = df.withColumn(name, df[f"`{name}`"].cast("timestamp_ntz"))
        return df

    return build
