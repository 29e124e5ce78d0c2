"""The served views as DataFrames over the serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import unit_scale
from ..functions.severity import AURORA, BZ, DST, KP, SPEED, band, classify
from ..functions.timeparts import epoch_millis
from ..operators.buckets import monthly_mean
from ..operators.carry import latest_row
from ..operators.clean import project
from ..operators.grid import left_join_predictions
from ..operators.publish import latest_published, latest_snapshot, slice_interval, slice_published
from ..operators.raster import grid_points, grid_summary
from ..schemas import SERVING
from ..sources.tables import read_or_empty

SPANS = {"24h": "24 hours", "7d": "7 days", "1mo": "1 month", "1y": "1 year"}


def _columns(requested: list[str] | None) -> list[str]:
    """Requested columns, all of them by default; unknown names fail in project()."""
    return ["time", *(requested or SERVING["solar"])]


def solar_raw(solar: DataFrame, span: str = "24h", columns: list[str] | None = None) -> DataFrame:
    if span not in ("24h", "7d"):
        raise ValueError(f"unknown interval: {span}")
    return project(slice_interval(solar, "time", SPANS[span]), _columns(columns))


def solar_monthly(hourly: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The last month of the complete-hour means."""
    return project(slice_interval(hourly, "time", SPANS["1mo"]), _columns(columns))


def solar_latest(solar: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return project(latest_row(solar, "time"), _columns(columns))


def dst_merged(
    predictions: DataFrame, observed: DataFrame, span: str = "7d", keys: list[str] | None = None
) -> DataFrame:
    """Predictions with observations where they exist; each series' window ends at its newest prediction.

    The predictions are cut to the window before they are joined.
    """
    keys = keys or []
    recent = slice_interval(predictions.select(*keys, "time", "dst_predictions"), "time", SPANS[span], keys)
    return left_join_predictions(recent, observed.select(*keys, "time", "dst"), keys, "time")


def series(table: DataFrame, span: str = "7d", keys: list[str] | None = None) -> DataFrame:
    return slice_interval(table, "time", SPANS[span], keys)


def dst_latest(dst: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return latest_row(dst.select(*(keys or []), "time", "dst"), "time", keys)


def kp_latest(kp: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return latest_row(kp.select(*(keys or []), "time", "Kp"), "time", keys)


def next_prediction(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The prediction that reaches furthest ahead."""
    return latest_row(predictions.select(*(keys or []), "time", "dst_predictions"), "time", keys)


class Served:
    """The same views over month-partitioned serving tables: only the months a view needs are read.

    Before a table's first publication its views have no rows.
    """

    def __init__(self, spark: SparkSession, root: str, derived: str | None = None) -> None:
        self.spark, self.root, self.derived = spark, root, derived or root

    @staticmethod
    def _schema(table: str) -> str:
        values = ", ".join(f"`{c}` double" for c in SERVING[table])
        return f"time timestamp_ntz, {values}, updated_at timestamp_ntz, month string"

    def _slice(self, path: str, span: str, table: str, columns: list[str] | None = None) -> DataFrame:
        rows = slice_published(self.spark, path, "time", SPANS[span], schema=self._schema(table))
        return project(rows, columns) if columns else rows

    def _latest(self, table: str) -> DataFrame:
        return latest_published(self.spark, f"{self.root}/{table}", "time", self._schema(table))

    def solar_raw(self, span: str = "24h", columns: list[str] | None = None) -> DataFrame:
        if span not in ("24h", "7d"):
            raise ValueError(f"unknown interval: {span}")
        return self._slice(f"{self.root}/solar", span, "solar", _columns(columns))

    def solar_monthly(self, columns: list[str] | None = None) -> DataFrame:
        return self._slice(f"{self.derived}/solar_hourly", "1mo", "solar", _columns(columns))

    def solar_latest(self, columns: list[str] | None = None) -> DataFrame:
        return project(self._latest("solar"), _columns(columns))

    def dst_merged(self, span: str = "7d") -> DataFrame:
        recent = self._slice(f"{self.root}/dst_predictions", span, "dst_predictions", ["time", "dst_predictions", "month"])
        months = [r[0] for r in recent.select("month").distinct().collect()]  # calendar-bounded
        observed = read_or_empty(self.spark, f"{self.root}/dst", self._schema("dst")).where(F.col("month").isin(months)).select("time", "dst")
        return left_join_predictions(recent.drop("month"), observed, [], "time")

    def kp(self, span: str = "7d") -> DataFrame:
        return self._slice(f"{self.root}/kp", span, "kp", ["time", "Kp"])

    def dst_latest(self) -> DataFrame:
        return self._latest("dst").select("time", "dst")

    def kp_latest(self) -> DataFrame:
        return self._latest("kp").select("time", "Kp")

    def next_prediction(self) -> DataFrame:
        return self._latest("dst_predictions").select("time", "dst_predictions")


def any_data(rows: DataFrame, cols: list[str]) -> DataFrame:
    """One row: does any row hold a value in any of the columns?"""
    known = F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    return rows.agg(F.coalesce(F.bool_or(known), F.lit(False)).alias("any_data"))


def chart_points(rows: DataFrame, col: str, time: str = "time", keys: list[str] | None = None) -> DataFrame:
    """(epoch milliseconds, value or NULL): a gap is never drawn as zero."""
    return rows.select(*(keys or []), epoch_millis(F.col(time)).alias("ms"), F.col(col).alias("value"))


def chart_temperature(rows: DataFrame) -> DataFrame:
    return rows.withColumn("temperature", unit_scale(F.col("temperature"), 1000))


def ssn_with_trend(ssn: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole cycle and its calendar-month means."""
    return ssn, monthly_mean(ssn, keys or [], "time", "swpc_ssn")


def nowcast(
    grid: DataFrame, retrieved: str = "retrieved_at", product: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(points, summary) of the newest grid, of each product if there are several; an archive without any snapshot yields no summary row,
    which is not the same as a snapshot whose points all fall below the floor."""
    product = product or []
    if product:
        newest_grid = latest_snapshot(grid, product, retrieved)
    else:
        newest_grid = grid.where(F.col(retrieved) == grid.agg(F.max(retrieved)).scalar())
    points = grid_points(newest_grid, "lon", "lat", "value")
    keys = [*product, "observation_time", "forecast_time"]
    shown = grid_summary(points, keys, "value")
    summary = newest_grid.select(*keys).distinct().join(shown, keys, "left").na.fill(0, ["point_count", "max_value"])
    return points, summary


def current_conditions(solar: DataFrame, dst: DataFrame, kp: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per reading: (reading, value, severity, band)."""
    cards = [
        (latest_row(solar.select("time", "speed"), "time"), "speed", SPEED, True),
        (latest_row(solar.select("time", "bz"), "time"), "bz", BZ, False),
        (latest_row(dst.select("time", "dst"), "time"), "dst", DST, False),
        (latest_row(kp.select("time", "Kp"), "time"), "Kp", KP, True),
        (summary, "max_value", AURORA, True),
    ]
    out = None
    for df, col, bounds, rising in cards:
        value = F.col(col).cast("double")
        gauge = band(value) if col == "Kp" else F.lit(None).cast("int")
        row = df.select(
            F.lit(col).alias("reading"), value.alias("value"), classify(value, bounds, rising).alias("severity"), gauge.alias("band")
        )
        out = row if out is None else out.unionByName(row)
    return out
