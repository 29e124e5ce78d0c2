"""Bucket aggregates, merges, publication and served views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.severity import AURORA, BZ, DST, KP, SPEED, band, classify
from ..functions.timeparts import floor_time, month_key
from ..operators.asof import asof_join, asof_slow
from ..operators.buckets import (
    complete_bucket_mean,
    complete_bucket_stats,
    in_complete_bucket,
    prune_buckets,
    recompute_touched,
)
from ..operators.carry import latest_row
from ..operators.merge import land_partitioned, land_single, last_wins, merge_records
from ..operators.publish import (
    change_feed,
    delta_merge,
    diff_upsert,
    feed_silence,
    fetch_counts,
    hours_of,
    latest_snapshot,
    partition_union,
    publish,
    retention_trim,
    slice_interval,
    sync_marker,
    table_health,
    upsert_lookback,
)
from ..operators.raster import grid_points, grid_summary
from ..plans.views import (
    Served,
    chart_temperature,
    current_conditions,
    dst_merged,
    nowcast,
    series,
    solar_latest,
    solar_monthly,
    solar_raw,
    ssn_with_trend,
)
from ..session import shared_folder
from ..sources.tables import lookback_scan, read_last_partitions
from . import adapters as A
from .registry import query

WEEK_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_WEEK_MEANS = ", ".join(f"round_even(round(avg({c}) * 100, 6), 0) / 100 AS {c}" for c in WEEK_COLS)
_WEEK_SQL = """SELECT l_returnflag, date_trunc('week', l_shipdate)::TIMESTAMP AS time, {means}
FROM {rows} GROUP BY ALL HAVING count(DISTINCT l_shipdate::DATE) = 7"""


def _items(spark, sf):
    cols = ["l_returnflag", "l_linestatus", F.col("l_shipdate").alias("time"), *WEEK_COLS]
    return A.table(spark, sf, "lineitem").select(*cols)


@query("complete_bucket_mean", _WEEK_SQL.format(means=_WEEK_MEANS, rows="lineitem"))
def complete_weeks(spark, sf):
    return complete_bucket_mean(_items(spark, sf), ["l_returnflag"], "time", WEEK_COLS, "week")


_DAYS = f"{A.HOURLY}, days AS (SELECT event_type, date_trunc('day', time)::TIMESTAMP AS time, count(v) AS n, avg(v) AS vm, stddev_samp(v) AS vs, avg(k) AS km, stddev_samp(k) AS ks FROM hourly GROUP BY ALL HAVING count(v) = 24)"
_DAY_COLS = "round(vm, 6) AS v_mean, round(vs, 6) AS v_std, round(km, 6) AS k_mean, round(ks, 6) AS k_std"


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c.endswith(("_mean", "_std")) else c for c in df.columns])


@query("complete_bucket_stats", f"WITH {_DAYS} SELECT event_type, time, {_DAY_COLS} FROM days")
def day_stats(spark, sf):
    return _rounded(complete_bucket_stats(A.hourly(spark, sf), ["event_type"], "time", ["v", "k"], "day"))


@query(
    "bucket_stats_empty",
    f"""WITH {_DAYS}, b AS (SELECT event_type, min(time) AS lo, max(time) AS hi FROM days GROUP BY 1),
 g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS time FROM b)
SELECT event_type, time, {_DAY_COLS} FROM g LEFT JOIN days USING (event_type, time)""",
)
def day_stats_empty(spark, sf):
    return _rounded(complete_bucket_stats(A.hourly(spark, sf), ["event_type"], "time", ["v", "k"], "day", emit_empty=True))


@query(
    "complete_bucket_rows",
    f"""WITH {A.HOURLY} SELECT event_type, time, v, k FROM hourly
QUALIFY count(v) OVER (PARTITION BY event_type, date_trunc('day', time)) = 24""",
)
def rows_of_full_days(spark, sf):
    return in_complete_bucket(A.hourly(spark, sf), ["event_type"], "time", "v", "day", 24)


@query(
    "monthly_mean",
    f"WITH {A.DAILY} SELECT date_trunc('month', time)::TIMESTAMP AS month, floor(round(avg(price) * 100, 6) + 0.5) / 100 AS monthly_mean FROM daily GROUP BY 1",
)
def month_means(spark, sf):
    return ssn_with_trend(A.daily(spark, sf).withColumnRenamed("price", "swpc_ssn"))[1]


# ---- merges ----

_RECORDS = "o_orderdate AS time_tag, o_orderpriority AS source, o_orderkey, o_totalprice"


def _records(spark, sf, condition):
    rows = A.table(spark, sf, "orders").where(condition)
    return rows.select(F.col("o_orderdate").alias("time_tag"), F.col("o_orderpriority").alias("source"), "o_orderkey", "o_totalprice")



def _pending():
    return F.col("o_orderstatus") == "P"


_MERGED = f"""settled AS (SELECT {_RECORDS} FROM orders WHERE o_orderstatus <> 'P'
    QUALIFY row_number() OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey DESC) = 1),
 pending AS (SELECT {_RECORDS} FROM orders WHERE o_orderstatus = 'P'
    QUALIFY row_number() OVER (PARTITION BY o_orderdate, o_orderpriority ORDER BY o_orderkey DESC) = 1),
 merged AS (SELECT * FROM pending UNION ALL
   SELECT s.* FROM settled s ANTI JOIN pending p ON s.time_tag = p.time_tag AND s.source = p.source)"""


@query("raw_merge_last_wins", f"WITH {_MERGED} SELECT *, strftime(time_tag, '%Y-%m') AS month FROM merged")
def merged(spark, sf):
    keys = ["time_tag", "source"]
    settled = last_wins(_records(spark, sf, ~_pending()), keys, "o_orderkey")
    both = merge_records(settled, _records(spark, sf, _pending()), keys, "o_orderkey")
    return both.withColumn("month", month_key(F.col("time_tag")))


@query(
    "keyed_dedupe",
    """SELECT l_orderkey, l_shipdate, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_extendedprice DESC) = 1""",
)
def deduped(spark, sf):
    rows = A.table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_extendedprice")
    return last_wins(rows, ["l_orderkey"], F.struct("l_shipdate", "l_linenumber", "l_extendedprice"))


@query("row_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def distinct_rows(spark, sf):
    return A.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate").dropDuplicates()


@query(
    "partition_last_two",
    f"""WITH {_MERGED}, m AS (SELECT DISTINCT strftime(time_tag, '%Y-%m') AS month FROM merged ORDER BY 1 DESC LIMIT 2)
SELECT time_tag, source, o_orderkey, o_totalprice, strftime(time_tag, '%Y-%m') AS month FROM merged
WHERE strftime(time_tag, '%Y-%m') IN (SELECT month FROM m)""",
)
def last_two_partitions(spark, sf):
    """Two landings into a month-partitioned raw table, then the scan of its last two months."""
    path = shared_folder(spark, "raw")
    for condition in (~_pending(), _pending()):
        payload = _records(spark, sf, condition).withColumn("arrival", F.col("o_orderkey"))
        land_partitioned(spark, path, payload, ["time_tag", "source"], "time_tag", "arrival")
    rows = read_last_partitions(spark, path, 2)
    return rows.withColumn("month", F.col("month").cast("string"))


@query(
    "partition_names",
    """SELECT DISTINCT strftime(t, '%Y-%m') AS month FROM (
  SELECT o_orderdate AS t FROM orders UNION ALL SELECT l_shipdate FROM lineitem)""",
)
def partition_names(spark, sf):
    months = lambda name, col: A.table(spark, sf, name).select(month_key(F.col(col)).alias("month")).distinct()
    return partition_union(months("orders", "o_orderdate"), months("lineitem", "l_shipdate"))


@query("single_merge", f"WITH {_MERGED} SELECT * FROM merged")
def single(spark, sf):
    """Two landings into an unpartitioned raw table."""
    path = shared_folder(spark, "single")
    for condition in (~_pending(), _pending()):
        land_single(
            spark, path, _records(spark, sf, condition).withColumn("arrival", F.col("o_orderkey")), ["time_tag", "source"], "arrival"
        )
    return spark.read.parquet(path)


# ---- publication ----

_T0, _T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def _by_day(rows):
    return rows.groupBy(F.col("o_orderdate").alias("time")).agg(
        F.max("o_totalprice").alias("price"), F.min("o_totalprice").alias("low")
    )


def _base(spark, sf):
    return _by_day(A.table(spark, sf, "orders").where(~_pending())).withColumn("updated_at", _stamp(_T0))


def _delta(spark, sf):
    return _by_day(A.table(spark, sf, "orders"))


_UPSERT = f"""base AS (SELECT o_orderdate AS time, max(o_totalprice) AS price, min(o_totalprice) AS low FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
 delta AS (SELECT o_orderdate AS time, max(o_totalprice) AS price, min(o_totalprice) AS low FROM orders GROUP BY 1),
 served AS (SELECT d.time, d.price, d.low,
   CASE WHEN b.time IS NULL OR b.price IS DISTINCT FROM d.price OR b.low IS DISTINCT FROM d.low
     THEN TIMESTAMP '{_T1}' ELSE TIMESTAMP '{_T0}' END AS updated_at
   FROM delta d LEFT JOIN base b ON b.time = d.time)"""


def _served(spark, sf):
    return diff_upsert(_base(spark, sf), _delta(spark, sf), ["time"], ["price", "low"], _stamp(_T1))


@query("diff_upsert", f"WITH {_UPSERT} SELECT * FROM served")
def upserted(spark, sf):
    return _served(spark, sf)


@query(
    "publish_table",
    f"WITH {_UPSERT} SELECT time, price, low, updated_at FROM served WHERE time >= (SELECT max(time) FROM served) - INTERVAL 1 YEAR",
)
def published(spark, sf):
    """The same upsert through a month-partitioned table on storage, then retention."""
    path = shared_folder(spark, "serving")
    publish(spark, path, _base(spark, sf), ["time"], ["price", "low"], _stamp(_T0))
    publish(spark, path, _delta(spark, sf), ["time"], ["price", "low"], _stamp(_T1), keep="1 year")
    return spark.read.parquet(path).select("time", "price", "low", "updated_at")


@query("upsert_lookback", f"WITH {A.DAILY} SELECT * FROM daily WHERE time >= (SELECT max(time) FROM daily) - INTERVAL 168 HOUR")
def lookback(spark, sf):
    return upsert_lookback(A.daily(spark, sf), "time", 168)


@query("retention_trim", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 YEAR")
def trimmed(spark, sf):
    return retention_trim(A.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1 year")


@query(
    "change_feed",
    f"""WITH {_UPSERT} SELECT * FROM served WHERE updated_at > TIMESTAMP '{_T0}'
  AND time >= (SELECT max(time) FROM served) - INTERVAL 744 DAY""",
)
def changes(spark, sf):
    return change_feed(_served(spark, sf), _stamp(_T0), held_days=744)


_DELTA_MERGE = f"""{_UPSERT}, state AS (SELECT * FROM delta UNION ALL SELECT * FROM base WHERE time NOT IN (SELECT time FROM delta)),
 kept AS (SELECT * FROM state WHERE time >= (SELECT max(time) FROM state) - INTERVAL 310 DAY)"""


@query("delta_merge", f"WITH {_DELTA_MERGE} SELECT time, price, low FROM kept")
def merged_state(spark, sf):
    return delta_merge(_base(spark, sf).drop("updated_at"), _delta(spark, sf), ["time"], "time", 310)[0]


@query("delta_changed_keys", f"WITH {_DELTA_MERGE} SELECT DISTINCT d.time FROM delta d SEMI JOIN kept k ON d.time = k.time")
def changed_keys(spark, sf):
    return delta_merge(_base(spark, sf).drop("updated_at"), _delta(spark, sf), ["time"], "time", 310)[1]


@query(
    "touched_buckets",
    f"""WITH open AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'),
 touched AS (SELECT DISTINCT l_returnflag, date_trunc('week', l_shipdate)::TIMESTAMP AS time FROM open),
 before AS ({_WEEK_SQL.format(means=_WEEK_MEANS, rows="(SELECT * FROM lineitem WHERE l_linestatus = 'F')")}),
 after AS ({_WEEK_SQL.format(means=_WEEK_MEANS, rows="lineitem")})
SELECT * FROM before b ANTI JOIN touched t ON b.l_returnflag = t.l_returnflag AND b.time = t.time
UNION ALL SELECT * FROM after a SEMI JOIN touched t ON a.l_returnflag = t.l_returnflag AND a.time = t.time""",
)
def touched(spark, sf):
    items = _items(spark, sf)
    closed = F.col("l_linestatus") == "F"
    before = complete_bucket_mean(items.where(closed), ["l_returnflag"], "time", WEEK_COLS, "week")
    return recompute_touched(items, items.where(~closed), before, ["l_returnflag"], "time", WEEK_COLS, "week")


@query(
    "prune_buckets",
    f"""WITH held AS (SELECT * FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 2 YEAR),
 weeks AS ({_WEEK_SQL.format(means=_WEEK_MEANS, rows="lineitem")})
SELECT * FROM weeks WHERE time >= (SELECT date_trunc('week', min(l_shipdate)) FROM held)""",
)
def pruned(spark, sf):
    held = retention_trim(_items(spark, sf), "time", "2 years")
    return prune_buckets(complete_weeks(spark, sf), held, "time", "week")


@query("touched_hours", "SELECT DISTINCT event_type, date_trunc('hour', ts) AS bucket FROM events")
def touched_hours(spark, sf):
    return hours_of(A.table(spark, sf, "events"), ["event_type"], "ts")


@query(
    "latest_snapshot",
    """SELECT event_type, event_id, date_trunc('hour', ts) AS retrieved_at, value FROM events
QUALIFY rank() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts) DESC) = 1""",
)
def snapshot(spark, sf):
    rows = A.table(spark, sf, "events").select(
        "event_type", "event_id", floor_time(F.col("ts"), "hour").alias("retrieved_at"), "value"
    )
    return latest_snapshot(rows, ["event_type"], "retrieved_at")


@query(
    "latest_per_series",
    """SELECT event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) = 1""",
)
def latest(spark, sf):
    return latest_row(A.table(spark, sf, "events").select("event_type", "ts", "event_id", "value"), "ts", ["event_type"])


@query("point_lookup", f"WITH {A.DAILY} SELECT * FROM daily WHERE time = TIMESTAMP '1998-10-03'")
def lookup_time(spark, sf):
    return A.daily(spark, sf).where(F.col("time") == _stamp("1998-10-03 00:00:00"))


@query("lookback_scan", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def scan_back(spark, sf):
    return lookback_scan(A.table(spark, sf, "events").select("event_id", "ts"), "ts", 7, _stamp("2024-01-30 00:00:00"))


# ---- served views ----


def _solar(spark, sf):
    ev = A.events(spark, sf).where(F.col("ts").isNotNull())
    return ev.select(F.col("ts").alias("time"), (F.col("value") * 5.0).alias("speed"), (F.col("k") / F.lit(-4.0)).alias("bz"))


_SOLAR = f"{A.EV}, sol AS (SELECT ts AS time, value * 5.0::DOUBLE AS speed, k / (-4.0)::DOUBLE AS bz FROM ev)"

for _span, _sql in (("24h", "24 HOUR"), ("7d", "7 DAY")):
    query(
        f"slice_{_span}",
        f"WITH {_SOLAR} SELECT time, bz, speed FROM sol WHERE time >= (SELECT max(time) FROM sol) - INTERVAL {_sql}",
    )(lambda spark, sf, span=_span: solar_raw(_solar(spark, sf), span, ["bz", "speed"]))


@query("slice_1mo", f"WITH {A.DAILY} SELECT * FROM daily WHERE time >= (SELECT max(time) FROM daily) - INTERVAL 1 MONTH")
def slice_month(spark, sf):
    return series(A.daily(spark, sf), "1mo")


@query(
    "slice_by_series",
    """SELECT event_type, ts, value FROM events e
WHERE ts >= (SELECT max(ts) FROM events x WHERE x.event_type = e.event_type) - INTERVAL 24 HOUR""",
)
def slice_series(spark, sf):
    rows = A.table(spark, sf, "events").select("event_type", "ts", "value")
    return slice_interval(rows, "ts", "24 hours", ["event_type"])


@query(
    "view_monthly",
    f"""WITH weeks AS ({_WEEK_SQL.format(means=_WEEK_MEANS, rows="lineitem")})
SELECT time, l_quantity, l_discount FROM weeks WHERE time >= (SELECT max(time) FROM weeks) - INTERVAL 1 MONTH""",
)
def monthly_view(spark, sf):
    return solar_monthly(complete_weeks(spark, sf), ["l_quantity", "l_discount"])


@query("view_latest", f"WITH {_SOLAR} SELECT time, speed, bz FROM sol ORDER BY time DESC LIMIT 1")
def latest_view(spark, sf):
    return solar_latest(_solar(spark, sf), ["speed", "bz"])


@query(
    "view_predictions",
    f"""WITH {A.FORECAST} SELECT status, time, dst_predictions, dst FROM pred LEFT JOIN obs USING (status, time)
WHERE time >= (SELECT max(time) FROM pred p WHERE p.status = pred.status) - INTERVAL 1 MONTH""",
)
def predictions_view(spark, sf):
    return dst_merged(A.predicted(spark, sf), A.observed(spark, sf), "1mo", ["status"])


# ---- series that lag behind ----

_LAG = """lagging AS (SELECT o_orderpriority AS series, o_orderdate - INTERVAL (o_custkey % 2 * 400) DAY AS time, max(o_totalprice) AS price, min(o_totalprice) AS low
  FROM orders WHERE o_custkey % 2 = (o_orderpriority < '3')::INTEGER GROUP BY ALL
  UNION ALL SELECT o_orderpriority || '+', o_orderdate, max(o_totalprice), min(o_totalprice) FROM orders WHERE o_custkey % 2 <> (o_orderpriority < '3')::INTEGER GROUP BY ALL)"""


def _lagging(spark, sf):
    """Daily peaks per priority, half of the series 400 days behind the others."""
    odd = F.pmod("o_custkey", F.lit(2))
    late = odd == (F.col("o_orderpriority") < "3").cast("int")
    days = F.when(late, odd * 400).otherwise(0).cast("int")
    series_ = F.when(late, F.col("o_orderpriority")).otherwise(F.concat("o_orderpriority", F.lit("+")))
    time = (F.col("o_orderdate") - F.make_dt_interval(days)).alias("time")
    return A.table(spark, sf, "orders").groupBy(series_.alias("series"), time).agg(F.max("o_totalprice").alias("price"), F.min("o_totalprice").alias("low"))


def _since(span):
    return f"time >= (SELECT max(time) FROM lagging x WHERE x.series = lagging.series) - INTERVAL {span}"


@query("retention_by_series", f"WITH {_LAG} SELECT * FROM lagging WHERE {_since('1 YEAR')}")
def retention_series(spark, sf):
    """Through storage: published by month, then trimmed; every series keeps its own last year."""
    path = shared_folder(spark, "trim")
    publish(spark, path, _lagging(spark, sf), ["series", "time"], ["price", "low"], _stamp(_T0), keep="1 year")
    return spark.read.parquet(path).select("series", "time", "price", "low")


@query("lookback_by_series", f"WITH {_LAG} SELECT * FROM lagging WHERE {_since('168 HOUR')}")
def lookback_series(spark, sf):
    return upsert_lookback(_lagging(spark, sf), "time", 168, ["series"])


_WRITTEN = f"{_LAG}, written AS (SELECT *, CASE WHEN price > 200000 THEN TIMESTAMP '{_T1}' ELSE TIMESTAMP '{_T0}' END AS updated_at FROM lagging)"


@query(
    "change_feed_by_series",
    f"""WITH {_WRITTEN} SELECT series, time, price, low, updated_at FROM written lagging WHERE updated_at > TIMESTAMP '{_T0}' AND {_since('310 DAY')}""",
)
def changes_series(spark, sf):
    at = F.when(F.col("price") > 200000, _stamp(_T1)).otherwise(_stamp(_T0))
    return change_feed(_lagging(spark, sf).withColumn("updated_at", at), _stamp(_T0), held_days=310, keys=["series"])


@query(
    "delta_merge_by_series",
    f"""WITH {_LAG}, state AS (SELECT series, time, CASE WHEN price > 200000 THEN price ELSE low END AS price FROM lagging)
SELECT * FROM state lagging WHERE {_since('310 DAY')}""",
)
def merged_series(spark, sf):
    rows = _lagging(spark, sf)
    held = rows.select("series", "time", F.col("low").alias("price"))
    delta = rows.where("price > 200000").select("series", "time", "price")
    return delta_merge(held, delta, ["series", "time"], "time", 310)[0]


@query(
    "asof_global_right",
    f"""WITH {_LAG}, {A.DAILY}, m AS (SELECT date_trunc('month', time)::TIMESTAMP AS time, floor(round(avg(price) * 100, 6) + 0.5) / 100 AS monthly_mean FROM daily GROUP BY 1)
SELECT l.series, l.time, l.price, m.monthly_mean FROM lagging l ASOF JOIN m ON l.time >= m.time""",
)
def asof_global(spark, sf):
    """One monthly series for every station."""
    right = ssn_with_trend(A.daily(spark, sf).withColumnRenamed("price", "swpc_ssn"))[1].withColumnRenamed("month", "time")
    return asof_join(_lagging(spark, sf).select("series", "time", "price"), right, ["series"], "time", ["monthly_mean"], "365 days")


@query(
    "asof_slow_right",
    f"""WITH {_SOLAR}, t AS (SELECT time FROM sol), r AS (SELECT time + INTERVAL 30 MINUTE AS time, max(speed) AS peak FROM sol WHERE bz < -20 GROUP BY 1)
SELECT t.time, r.peak FROM t ASOF JOIN r ON t.time >= r.time""",
)
def asof_slow_right(spark, sf):
    solar = _solar(spark, sf)
    right = solar.where("bz < -20").groupBy((F.col("time") + F.expr("INTERVAL 30 MINUTES")).alias("time")).agg(F.max("speed").alias("peak"))
    return asof_slow(solar.select("time"), right, [], "time", "peak")


# ---- views over published tables ----


def _published_orders(spark, sf):
    """Daily peaks and lows as the dst, predictions and Kp tables of a serving folder."""
    root = shared_folder(spark, "served")
    rows = A.daily(spark, sf)
    tables = {"dst_predictions": ("dst_predictions", 1.0), "dst": ("dst", -1.0), "kp": ("Kp", 0.001)}
    for name, (col, factor) in tables.items():
        publish(spark, f"{root}/{name}", rows.select("time", (F.col("price") * factor).alias(col)), ["time"], [col], _stamp(_T0))
    return Served(spark, root)


@query(
    "view_published_predictions",
    f"WITH {A.DAILY} SELECT time, price AS dst_predictions, -price AS dst FROM daily WHERE time >= (SELECT max(time) FROM daily) - INTERVAL 1 MONTH",
)
def published_predictions(spark, sf):
    return _published_orders(spark, sf).dst_merged("1mo")


@query("view_published_kp", f"WITH {A.DAILY} SELECT time, price * 0.001::DOUBLE AS \"Kp\" FROM daily WHERE time >= (SELECT max(time) FROM daily) - INTERVAL 7 DAY")
def published_kp(spark, sf):
    return _published_orders(spark, sf).kp("7d")


@query(
    "views_latest",
    f"""WITH {A.DAILY}, l AS (SELECT * FROM daily ORDER BY time DESC LIMIT 1)
SELECT 'dst' AS reading, time, -price AS value FROM l UNION ALL SELECT 'kp', time, price * 0.001::DOUBLE FROM l
UNION ALL SELECT 'next', time, price FROM l""",
)
def views_latest(spark, sf):
    served = _published_orders(spark, sf)
    cards = {"dst": served.dst_latest(), "kp": served.kp_latest(), "next": served.next_prediction()}
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("reading"), "time", F.col(d.columns[1]).alias("value")) for n, d in cards.items()])


@query(
    "view_nowcast",
    f"""WITH {A.GRID}, newest AS (SELECT *, label AS product FROM cells c WHERE snap = (SELECT max(snap) FROM cells x WHERE x.label = c.label)),
 shown AS (SELECT product, count(*) AS point_count, max(value) AS max_value FROM newest WHERE value >= 2 AND abs(lat) >= 20 GROUP BY 1)
SELECT product, coalesce(point_count, 0) AS point_count, coalesce(max_value, 0) AS max_value FROM (SELECT DISTINCT product FROM newest) LEFT JOIN shown USING (product)""",
)
def nowcast_view(spark, sf):
    grid = A.grid_cells(spark, sf).withColumnsRenamed({"label": "product", "snap": "retrieved_at"})
    grid = grid.withColumns({"observation_time": F.lit("o"), "forecast_time": F.lit("f")})
    return nowcast(grid, product=["product"])[1].select("product", "point_count", "max_value")


@query("chart_scaled", f"WITH {_SOLAR} SELECT time, speed / 1000 AS temperature FROM sol")
def chart_scaled(spark, sf):
    return chart_temperature(_solar(spark, sf).select("time", F.col("speed").alias("temperature")))


@query("run_marker", "SELECT max(o_orderdate) AS last_synced, count(*) AS orders FROM orders")
def run_marker(spark, sf):
    """The time of the last run, written and read back, beside the table it is about."""
    orders, path = A.table(spark, sf, "orders"), shared_folder(spark, "marker")
    for frame in (orders.where("o_orderstatus = 'F'"), orders):
        sync_marker(spark, path, frame.agg(F.max("o_orderdate")).scalar())
    return spark.read.parquet(path).withColumn("orders", orders.agg(F.count("*")).scalar())


@query("full_series", f"WITH {A.DAILY} SELECT * FROM daily ORDER BY time")
def full_series(spark, sf):
    return ssn_with_trend(A.daily(spark, sf).withColumnRenamed("price", "swpc_ssn"))[0].withColumnRenamed("swpc_ssn", "price").orderBy("time")


def _severity_sql(col, bounds, rising):
    sign = ">=" if rising else "<="
    return "CASE " + " ".join(f"WHEN {col} {sign} {b} THEN '{label}'" for label, b in bounds.items()) + " ELSE 'quiet' END"


@query(
    "severity_high",
    f"""WITH {A.EV} SELECT event_id, {_severity_sql('k / 11.0::DOUBLE', KP, True)} AS kp, {_severity_sql('value * 5', SPEED, True)} AS speed,
  {_severity_sql('k', AURORA, True)} AS aurora FROM ev""",
)
def severity_high(spark, sf):
    return A.events(spark, sf).select(
        "event_id",
        classify(F.col("k") / F.lit(11.0), KP).alias("kp"),
        classify(F.col("value") * 5, SPEED).alias("speed"),
        classify(F.col("k"), AURORA).alias("aurora"),
    )


@query(
    "severity_low",
    f"""WITH {A.EV} SELECT event_id, {_severity_sql('-value', DST, False)} AS dst, {_severity_sql('k / (-4.0)::DOUBLE', BZ, False)} AS bz FROM ev""",
)
def severity_low(spark, sf):
    return A.events(spark, sf).select(
        "event_id", classify(-F.col("value"), DST, False).alias("dst"), classify(F.col("k") / F.lit(-4.0), BZ, False).alias("bz")
    )


@query(
    "gauge_band",
    f"""WITH {A.EV}, g AS (SELECT event_id, k / 11.0::DOUBLE AS x FROM ev) SELECT event_id,
  CASE WHEN x < 4 THEN 0 WHEN x < 5 THEN 1 WHEN x < 7 THEN 2 WHEN x < 8 THEN 3 WHEN x <= 9 THEN 4 END AS band FROM g""",
)
def gauge(spark, sf):
    return A.events(spark, sf).select("event_id", band(F.col("k") / F.lit(11.0)).alias("band"))


@query(
    "current_conditions",
    f"""WITH {_SOLAR}, {A.GRID}, last AS (SELECT * FROM sol ORDER BY time DESC LIMIT 1),
 d AS (SELECT -value AS v FROM ev ORDER BY ts DESC LIMIT 1), p AS (SELECT k / 11.0::DOUBLE AS v FROM ev ORDER BY ts DESC LIMIT 1),
 top AS (SELECT coalesce(max(value), 0) AS v FROM cells WHERE value >= 2 AND abs(lat) >= 20)
SELECT 'speed' AS reading, speed AS value, {_severity_sql('speed', SPEED, True)} AS severity, NULL::INTEGER AS band FROM last
UNION ALL SELECT 'bz', bz, {_severity_sql('bz', BZ, False)}, NULL FROM last
UNION ALL SELECT 'dst', v, {_severity_sql('v', DST, False)}, NULL FROM d
UNION ALL SELECT 'Kp', v, {_severity_sql('v', KP, True)}, CASE WHEN v < 4 THEN 0 WHEN v < 5 THEN 1 WHEN v < 7 THEN 2 WHEN v < 8 THEN 3 ELSE 4 END FROM p
UNION ALL SELECT 'max_value', v, {_severity_sql('v', AURORA, True)}, NULL FROM top""",
)
def conditions(spark, sf):
    ev = A.events(spark, sf)
    dst = ev.select(F.col("ts").alias("time"), (-F.col("value")).alias("dst"))
    kp = ev.select(F.col("ts").alias("time"), (F.col("k") / F.lit(11.0)).alias("Kp"))
    summary = grid_summary(grid_points(A.grid_cells(spark, sf), "lon", "lat", "value"), [], "value")
    return current_conditions(_solar(spark, sf), dst, kp, summary)


@query(
    "feed_health",
    """WITH h AS (SELECT 'orders' AS "table", count(*) AS "rows", max(o_orderdate) AS last_updated_at FROM orders
  UNION ALL SELECT 'lineitem', count(*), max(l_shipdate) FROM lineitem UNION ALL SELECT 'events', count(*), max(ts) FROM events)
SELECT *, CASE WHEN (SELECT bool_and(last_updated_at IS NOT NULL) FROM h) THEN 'ok' ELSE 'warming_up' END AS status FROM h""",
)
def health(spark, sf):
    stamps = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
    return table_health({n: A.table(spark, sf, n).select(F.col(c).alias("updated_at")) for n, c in stamps.items()})


@query(
    "feed_silence",
    """WITH f AS (SELECT event_type, max(ts) FILTER (WHERE value >= 30) AS last_ok FROM events GROUP BY 1)
SELECT *, last_ok IS NULL OR last_ok < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS silent FROM f""",
)
def silence(spark, sf):
    log = A.table(spark, sf, "events").withColumn("ok", F.col("value") >= 30)
    as_of = log.agg(F.max("ts")).scalar()
    return feed_silence(log, "event_type", "ts", "ok", as_of)


@query(
    "fetch_counts",
    """SELECT event_type, count(*) FILTER (WHERE value >= 30) AS successes, count(*) FILTER (WHERE NOT value >= 30) AS failures
FROM events GROUP BY 1""",
)
def fetches(spark, sf):
    return fetch_counts(A.table(spark, sf, "events").withColumn("ok", F.col("value") >= 30), "event_type", "ok")


@query(
    "key_sets",
    """SELECT 'both' AS side, time FROM (SELECT o_orderdate AS time FROM orders INTERSECT SELECT l_shipdate FROM lineitem)
UNION ALL SELECT 'orders_only', time FROM (SELECT o_orderdate AS time FROM orders EXCEPT SELECT l_shipdate FROM lineitem)""",
)
def key_sets(spark, sf):
    ordered = A.table(spark, sf, "orders").select(F.col("o_orderdate").alias("time")).distinct()
    shipped = A.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("time")).distinct()
    sides = {"both": ordered.intersect(shipped), "orders_only": ordered.subtract(shipped)}
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("side"), "time") for n, d in sides.items()])


@query("multi_sort", "SELECT o_orderdate, o_orderpriority, o_orderkey FROM orders ORDER BY o_orderdate, o_orderpriority DESC, o_orderkey")
def multi_sort(spark, sf):
    rows = A.table(spark, sf, "orders").select("o_orderdate", "o_orderpriority", "o_orderkey")
    return rows.orderBy(F.asc("o_orderdate"), F.desc("o_orderpriority"), F.asc("o_orderkey"))


@query(
    "union_all",
    """SELECT o_orderdate AS time, o_totalprice AS amount FROM orders
UNION ALL SELECT l_shipdate, l_extendedprice FROM lineitem""",
)
def union_all(spark, sf):
    orders = A.table(spark, sf, "orders").select(F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("amount"))
    items = A.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("time"), F.col("l_extendedprice").alias("amount"))
    return orders.unionByName(items)
