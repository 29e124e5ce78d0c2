"""Streaming queries, run over all available input and read back as tables."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from ..functions.timeparts import floor_time
from ..operators.cursor import run_poll
from ..operators.merge import last_wins
from ..operators.publish import publish
from ..session import shared_folder
from ..streaming.bucket_state import bucket_changes, write_buckets
from ..streaming.incremental import prune_published, refresh_buckets, refresh_join, stream_bucket_mean, stream_dedupe, upsert_stream, write_table
from . import adapters as A
from .registry import query
from .serving import _stamp


def _stream(spark, sf, name):
    schema = A.table(spark, sf, name).schema
    # A stream source wants a folder or a pattern; this pattern matches the table either way.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def _drain(spark, stream):
    path = shared_folder(spark, "stream")
    write_table(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


@query(
    "stream_bucket_mean",
    """WITH d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS time, round_even(round(avg(value) * 100, 6), 0) / 100 AS value,
    count(DISTINCT extract('hour' FROM ts)) AS hours FROM events GROUP BY 1, 2)
SELECT event_type, time, value FROM d WHERE hours = 24 AND time + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
)
def bucket_mean(spark, sf):
    return _drain(spark, stream_bucket_mean(_stream(spark, sf, "events"), ["event_type"], "ts", ["value"], "day"))


@query("stream_dedupe", "SELECT DISTINCT event_type, date_trunc('hour', ts) AS time FROM events")
def dedupe(spark, sf):
    rows = _stream(spark, sf, "events").select("event_type", floor_time(F.col("ts"), "hour").alias("time"))
    return _drain(spark, stream_dedupe(rows, ["event_type", "time"], "time"))


_LATEST = """hourly AS (SELECT event_type, date_trunc('hour', ts) AS time, value FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) = 1)"""


def _upserted(spark, sf, after=None):
    root = shared_folder(spark, "upsert")
    rows = _stream(spark, sf, "events").select("event_type", floor_time(F.col("ts"), "hour").alias("time"), "value", "event_id")
    hook = after(f"{root}/table", f"{root}/days") if after else None
    upsert_stream(
        spark, rows, f"{root}/table", f"{root}/checkpoint", ["event_type", "time"], ["value"],
        seq="event_id", now=_stamp("2024-02-01 00:00:00"), after=hook,
    ).awaitTermination()
    return root


@query("stream_upsert", f"WITH {_LATEST} SELECT *, TIMESTAMP '2024-02-01' AS updated_at FROM hourly")
def upsert(spark, sf):
    return spark.read.parquet(f"{_upserted(spark, sf)}/table").select("event_type", "time", "value", "updated_at")


@query(
    "stream_touched_buckets",
    f"""WITH {_LATEST} SELECT event_type, date_trunc('day', time)::TIMESTAMP AS time, round_even(round(avg(value) * 100, 6), 0) / 100 AS value
FROM hourly GROUP BY ALL HAVING count(*) = 24""",
)
def touched(spark, sf):
    """Upsert stream whose hook keeps the daily means of complete days current."""
    root = _upserted(
        spark, sf, lambda base, days: refresh_buckets(spark, base, days, ["event_type"], "time", ["value"], "day")
    )
    schema = "event_type string, time timestamp_ntz, value double"
    return spark.read.schema(schema).parquet(f"{root}/days").select("event_type", "time", "value")


@query(
    "stream_touched_weeks",
    """WITH d AS (SELECT l_returnflag, l_shipdate AS time, avg(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
SELECT l_returnflag, date_trunc('week', time)::TIMESTAMP AS time, round_even(round(avg(l_quantity) * 100, 6), 0) / 100 AS l_quantity
FROM d GROUP BY ALL HAVING count(*) = 7""",
)
def touched_weeks(spark, sf):
    """Two streams of the same table: weeks that cross a month are corrected by the second."""
    root = shared_folder(spark, "weeks")
    keys, cols = ["l_returnflag", "time"], ["l_quantity"]
    days = A.table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").alias("time")).agg(F.avg("l_quantity").alias("l_quantity"))
    wrong = days.where("day(time) > 3 OR day(time) < 2").withColumn("l_quantity", F.col("l_quantity") + F.when(F.dayofmonth("time") == 1, 5.0).otherwise(0.0))
    for part, rows in (("a", wrong), ("b", days)):
        rows.write.parquet(f"{root}/{part}")
        upsert_stream(
            spark, spark.readStream.schema(rows.schema).parquet(f"{root}/{part}"), f"{root}/table", f"{root}/checkpoint-{part}", keys, cols,
            now=_stamp("2024-02-01 00:00:00"), after=refresh_buckets(spark, f"{root}/table", f"{root}/weeks", ["l_returnflag"], "time", cols, "week"),
        ).awaitTermination()
    schema = "l_returnflag string, time timestamp_ntz, l_quantity double"
    return spark.read.schema(schema).parquet(f"{root}/weeks").select("l_returnflag", "time", "l_quantity")


@query(
    "stream_refresh_join",
    """WITH p AS (SELECT o_orderdate AS time, max(o_totalprice) AS dst_predictions FROM orders GROUP BY 1),
 o AS (SELECT l_shipdate AS time, max(l_extendedprice) AS dst FROM lineitem GROUP BY 1) SELECT time, dst_predictions, dst FROM p LEFT JOIN o USING (time)""",
)
def refreshed_join(spark, sf):
    """Predictions and observations streamed in; the joined table is rebuilt after each batch."""
    root = shared_folder(spark, "joined")
    hook = refresh_join(spark, f"{root}/predictions", f"{root}/observed", f"{root}/merged")
    sources = {
        "observed": (A.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("time")).agg(F.max("l_extendedprice").alias("dst")), "dst"),
        "predictions": (A.table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("time")).agg(F.max("o_totalprice").alias("dst_predictions")), "dst_predictions"),
    }
    for name, (rows, col) in sources.items():
        rows.write.parquet(f"{root}/in-{name}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in-{name}")
        upsert_stream(spark, stream, f"{root}/{name}", f"{root}/checkpoint-{name}", ["time"], [col], now=_stamp("2024-02-01 00:00:00"), after=hook).awaitTermination()
    return spark.read.parquet(f"{root}/merged").select("time", "dst_predictions", "dst")


def _stateful(spark, sf, parts, held_days=None):
    """Daily means kept in the state of one stream, run once for each part as it is delivered."""
    root = shared_folder(spark, "state")
    keys, schema = ["event_type"], "event_type string, time timestamp_ntz, value double, event_id bigint, gone boolean"
    for rows in parts:
        rows.select("event_type", "time", "value", "event_id", "gone").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).parquet(f"{root}/in")
        changes = bucket_changes(stream, keys, "time", ["value"], "day", "event_id", "gone", held_days)
        write_buckets(spark, changes, f"{root}/days", f"{root}/checkpoint", keys, ["value"]).awaitTermination()
    return spark.read.schema("event_type string, time timestamp_ntz, value double").parquet(f"{root}/days").select("event_type", "time", "value")


def _hourly(spark, sf):
    rows = A.table(spark, sf, "events").select("event_type", floor_time(F.col("ts"), "hour").alias("time"), "value", "event_id")
    return rows.withColumn("gone", F.lit(False))


@query(
    "stream_hour_state",
    f"""WITH {_LATEST} SELECT event_type, date_trunc('day', time)::TIMESTAMP AS time, round_even(round(avg(value) * 100, 6), 0) / 100 AS value
FROM hourly WHERE day(time) % 7 <> 0 GROUP BY ALL HAVING count(*) = 24""",
)
def hour_state(spark, sf):
    """Early readings first, then later ones that replace some of them, then an hour of every seventh day is taken out."""
    rows = _hourly(spark, sf)
    late = F.pmod("event_id", F.lit(3)) == 0
    gone = rows.where("hour(time) = 5 AND day(time) % 7 = 0").withColumn("gone", F.lit(True))
    early = rows.where(~late).withColumn("value", F.col("value") + F.when(F.pmod("event_id", F.lit(5)) == 0, 1.0).otherwise(0.0))
    return _stateful(spark, sf, [early, rows, gone])


_LAGGING = """shifted AS (SELECT event_type, date_trunc('hour', ts) - CASE WHEN event_type = 'click' THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END AS time, value, event_id FROM events),
  hourly AS (SELECT event_type, time, value FROM shifted QUALIFY row_number() OVER (PARTITION BY event_type, time ORDER BY event_id DESC) = 1),
  held AS (SELECT event_type, date_trunc('day', min(time)) AS first FROM (SELECT *, max(time) OVER (PARTITION BY event_type) AS newest FROM hourly) WHERE time >= newest - INTERVAL 10 DAY GROUP BY event_type),
  days AS (SELECT event_type, date_trunc('day', time)::TIMESTAMP AS time, round_even(round(avg(value) * 100, 6), 0) / 100 AS value FROM hourly GROUP BY ALL HAVING count(*) = 24)"""


def _lagging(spark, sf):
    """The hourly readings, one type 20 days behind the others."""
    return _hourly(spark, sf).withColumn("time", F.when(F.col("event_type") == "click", F.col("time") - F.expr("INTERVAL 20 DAYS")).otherwise(F.col("time")))


@query("stream_state_ttl", f"WITH {_LAGGING} SELECT event_type, time, value FROM days JOIN held USING (event_type) WHERE time >= first")
def state_ttl(spark, sf):
    """Ten days of buckets held for each series, in two deliveries; the series that lags keeps its own ten days."""
    rows = _lagging(spark, sf)
    middle = rows.agg((F.min("time") + (F.max("time") - F.min("time")) / 2)).scalar()
    return _stateful(spark, sf, [rows.where(F.col("time") < middle), rows], held_days=10)


@query("prune_by_series", f"WITH {_LAGGING} SELECT event_type, time, value FROM days JOIN held USING (event_type) WHERE time >= first")
def prune_by_series(spark, sf):
    """The same of a published table: each series loses the buckets before its own oldest held row."""
    root, keys = shared_folder(spark, "prune"), ["event_type", "time"]
    rows = last_wins(_lagging(spark, sf).select(*keys, "value", "event_id"), keys, "event_id").select(*keys, "value")
    publish(spark, f"{root}/base", rows, keys, ["value"], _stamp("2024-02-01 00:00:00"))
    refresh_buckets(spark, f"{root}/base", f"{root}/days", ["event_type"], "time", ["value"], "day")(rows.select(*keys))
    prune_published(spark, f"{root}/base", f"{root}/days", "time", "day", 10, ["event_type"])
    return spark.read.schema("event_type string, time timestamp_ntz, value double").parquet(f"{root}/days").select("event_type", "time", "value")


@query(
    "change_feed_cursor",
    """WITH d AS (SELECT o_orderdate AS time, max(o_totalprice) AS price, min(o_totalprice) AS low FROM orders GROUP BY 1)
SELECT 0 AS poll, time, low AS price FROM d UNION ALL SELECT 1, time, price FROM d WHERE price <> low AND month(time) <= 6
UNION ALL SELECT 2, time, price FROM d WHERE price <> low AND month(time) > 6""",
)
def change_feed_cursor(spark, sf):
    """Three states of a table polled; the second poll fails after its changes were written and runs again."""
    root = shared_folder(spark, "polls")
    days = A.table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("time")).agg(F.max("o_totalprice").alias("price"), F.min("o_totalprice").alias("low"))
    path = f"{root}/served"

    def apply(rows, poll, fail=False):
        rows.select("time", "price").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/changes/poll={poll.number}")
        if fail:
            raise InterruptedError("lost between the changes and the cursor")

    def poll(fail=False):
        return run_poll(spark, path, f"{root}/log", "reader", lambda rows, p: apply(rows, p, fail))

    publish(spark, path, days.select("time", F.col("low").alias("price")), ["time"], ["price"], _stamp("2024-01-01 00:00:00"))
    poll()
    publish(spark, path, days.where("month(time) <= 6").select("time", "price"), ["time"], ["price"], _stamp("2024-01-02 00:00:00"))
    with contextlib.suppress(InterruptedError):
        poll(fail=True)
    publish(spark, path, days.where("month(time) > 6").select("time", "price"), ["time"], ["price"], _stamp("2024-01-03 00:00:00"))
    while poll():
        pass
    return spark.read.schema("time timestamp_ntz, price double, poll int").parquet(f"{root}/changes").select("poll", "time", "price")
