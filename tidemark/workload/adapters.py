"""The given tables seen as feeds and series, in Spark and in SQL.

Each adapter is a pair: a function returning the DataFrame and a SQL text of common table
expressions that defines the same relation under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import positive_only
from ..functions.timeparts import floor_time
from ..operators.grid import reindex
from ..operators.merge import last_wins

PRIORITY = {"signup": 0, "purchase": 1, "click": 2, "view": 3}  # 'error' is an unknown source
HEIGHT, CELLS = 181, 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """events with k parsed out of props."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))


EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """One record per (hour, source), the last one written; low values are missing."""
    ev = events(spark, sf)
    raw = ev.select(
        floor_time(F.col("ts"), "hour").alias("time"),
        F.col("event_type").alias("source"),
        (F.minute("ts") < 40).alias("active"),
        F.when(F.col("value") >= 30, F.col("value")).alias("a"),
        F.when(F.col("k") >= 50, F.col("k").cast("double")).alias("b"),
        "event_id",
    )
    return last_wins(raw, ["time", "source"], "event_id").drop("event_id")


READINGS = f"""{EV}, readings AS (
  SELECT date_trunc('hour', ts) AS time, event_type AS source, extract('minute' FROM ts) < 40 AS active,
    CASE WHEN value >= 30 THEN value END AS a, CASE WHEN k >= 50 THEN k::DOUBLE END AS b,
    CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 999 END AS prio
  FROM ev QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY event_id DESC) = 1)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, time, v, k): hourly peaks; some hours have no row, some v are not positive."""
    return (
        events(spark, sf)
        .groupBy("event_type", floor_time(F.col("ts"), "hour").alias("time"))
        .agg((F.max("value") - 25.0).alias("v"), F.max("k").cast("double").alias("k"))
    )


HOURLY = f"""{EV}, hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS time, max(value) - 25.0::DOUBLE AS v, max(k)::DOUBLE AS k
  FROM ev GROUP BY ALL)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """hourly on a complete hourly grid per event type; v is NULL where missing or not positive."""
    on_grid = reindex([hourly(spark, sf)], ["event_type"], "time", "1 hour", "30 days")
    return on_grid.withColumn("v", positive_only(F.col("v")))


GAPPY = f"""{HOURLY}, spans AS (
  SELECT event_type, min(time) AS lo, max(time) AS hi FROM hourly GROUP BY event_type), grid AS (
  SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS time FROM spans), gappy AS (
  SELECT g.event_type, g.time, CASE WHEN h.v > 0 THEN h.v END AS v, h.k
  FROM grid g LEFT JOIN hourly h ON g.event_type = h.event_type AND g.time = h.time)"""


def filled_sql(value: str, source: str, key: str, out: str) -> str:
    """CTE `out`: `source` with `value` interpolated by position and filled at both ends."""
    part = f"PARTITION BY {key} " if key else ""
    keys = f"{key}, " if key else ""
    return f"""{out}_n AS (
  SELECT {keys}time, {value}, row_number() OVER ({part}ORDER BY time) AS pos FROM {source}), {out}_w AS (
  SELECT *, last_value(CASE WHEN {value} IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS lp,
    last_value({value} IGNORE NULLS) OVER b AS lv,
    first_value(CASE WHEN {value} IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np,
    first_value({value} IGNORE NULLS) OVER a AS nv FROM {out}_n
  WINDOW b AS ({part}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS ({part}ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), {out} AS (
  SELECT {keys}time, CASE WHEN {value} IS NOT NULL THEN {value}
    WHEN lv IS NOT NULL AND nv IS NOT NULL THEN (nv - lv) / (np - lp)::DOUBLE * (pos - lp)::DOUBLE + lv
    ELSE coalesce(lv, nv) END AS {value} FROM {out}_w)"""


def masked_sql(value: str, source: str, key: str, out: str, q: float = 0.97) -> str:
    """CTE `out`: `source` with `value` NULL where its rate of change exceeds the q-quantile."""
    part = f"PARTITION BY {key}" if key else ""
    keys = f"{key}, " if key else ""
    on = f"o.{key} = t.{key}" if key else "TRUE"
    group = f"GROUP BY {key}" if key else ""
    return f"""{out}_r AS (
  SELECT {keys}time, {value}, abs({value} - lag({value}) OVER ({part} ORDER BY time)) AS roc FROM {source}), {out}_s AS (
  SELECT {keys}roc, row_number() OVER ({part} ORDER BY roc) - 1 AS rk, count(*) OVER ({part}) - 1 AS n
  FROM {out}_r WHERE roc IS NOT NULL), {out}_e AS (
  SELECT {keys}max(CASE WHEN rk = floor(n * {q}::DOUBLE) THEN roc END) AS lo,
    max(CASE WHEN rk = least(floor(n * {q}::DOUBLE) + 1, n) THEN roc END) AS hi,
    max(n * {q}::DOUBLE - floor(n * {q}::DOUBLE)) AS t FROM {out}_s {group}), {out}_t AS (
  SELECT {keys}CASE WHEN t >= 0.5 THEN hi - (hi - lo) * (1 - t) ELSE lo + (hi - lo) * t END AS thr FROM {out}_e), {out} AS (
  SELECT {'o.' + key + ', ' if key else ''}o.time, CASE WHEN o.roc > t.thr THEN NULL ELSE o.{value} END AS {value}
  FROM {out}_r o LEFT JOIN {out}_t t ON {on})"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(time, price): the day's largest order."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("time")).agg(F.max("o_totalprice").alias("price"))


DAILY = "daily AS (SELECT o_orderdate AS time, max(o_totalprice) AS price FROM orders GROUP BY 1)"


def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as stacked snapshots: 181 vectors are the latitudes, their 64 values the longitudes."""
    rows = table(spark, sf, "embeddings")
    return rows.select(
        "label",
        F.floor(F.col("vec_id") / HEIGHT).cast("bigint").alias("snap"),
        (F.pmod("vec_id", F.lit(HEIGHT)) - 90).cast("int").alias("lat"),
        F.posexplode("embedding").alias("seq", "e"),
    ).select("label", "snap", "lat", "seq", (F.col("seq") - 32).alias("lon"), (F.col("e").cast("double") * 400.0).alias("value"))


GRID = """cells AS (
  SELECT label, vec_id // 181 AS snap, (vec_id % 181 - 90)::INTEGER AS lat, (u.i - 1)::INTEGER AS seq, (u.i - 33)::INTEGER AS lon,
    embedding[u.i]::DOUBLE * 400.0::DOUBLE AS value
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) u)"""


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("time"))
    return rows.agg(F.min("o_totalprice").alias("dst_predictions"))


def observed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("time"))
    return rows.agg(F.min("l_extendedprice").alias("dst"))


FORECAST = """pred AS (SELECT o_orderstatus AS status, o_orderdate AS time, min(o_totalprice) AS dst_predictions FROM orders GROUP BY 1, 2),
 obs AS (SELECT l_linestatus AS status, l_shipdate AS time, min(l_extendedprice) AS dst FROM lineitem GROUP BY 1, 2)"""
