"""Source selection, grids, masks, fills and joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalar import FEATURE_STATS, denormalise, dynamic_pressure, normalise, round_half_even
from ..functions.timeparts import floor_time
from ..operators.asof import asof_join
from ..operators.buckets import monthly_mean
from ..operators.carry import fill_gaps, rate_of_change, tail_rows
from ..operators.clean import mask_and_fill, mask_invalid, mask_outliers, minute_boundary, project, to_double
from ..operators.grid import anti_append, left_join_predictions, outer_join_series, overlay, regular_grid
from ..operators.quantile import quantiles
from ..operators.sequences import LinearScorer
from ..operators.thresholds import published_thresholds, update_rates
from ..operators.select_source import first_valid_by_priority, select_source, source_rank
from ..plans.indices import clean_index
from ..plans.predict import predict
from ..plans.solar import clean_solar
from ..plans.features import FEATURE_COLS, prepare_features
from ..plans.views import any_data, chart_points
from ..session import shared_folder, staged
from . import adapters as A
from .registry import query


@query(
    "source_select",
    f"""WITH {A.READINGS}, g AS (
  SELECT time, bool_or(active) AS ha, bool_or(NOT active AND a IS NOT NULL AND b IS NOT NULL) AS iv,
    arg_min(a, prio) FILTER (WHERE active AND a IS NOT NULL) AS aa, arg_min(b, prio) FILTER (WHERE active AND b IS NOT NULL) AS ab,
    arg_min(a, prio) FILTER (WHERE NOT active AND a IS NOT NULL) AS ia, arg_min(b, prio) FILTER (WHERE NOT active AND b IS NOT NULL) AS ib
  FROM readings GROUP BY time), u AS (SELECT *, NOT ha OR (aa IS NULL AND ab IS NULL AND iv) AS swap FROM g)
SELECT time, CASE WHEN swap THEN ia ELSE aa END AS a, CASE WHEN swap THEN ib ELSE ab END AS b FROM u""",
)
def source_select(spark, sf):
    return select_source(A.readings(spark, sf), ["time"], ["a", "b"], priority=A.PRIORITY)


@query(
    "first_valid_by_priority",
    f"""WITH {A.READINGS}
SELECT time, arg_min(a, prio) FILTER (WHERE a IS NOT NULL) AS a, arg_min(b, prio) FILTER (WHERE b IS NOT NULL) AS b
FROM readings GROUP BY time""",
)
def first_valid(spark, sf):
    rank = source_rank(F.col("source"), A.PRIORITY)
    return first_valid_by_priority(A.readings(spark, sf), ["time"], ["a", "b"], rank)


@query("boundary_filter", "SELECT event_id, ts, value FROM events WHERE floor(extract('second' FROM ts)) = 0")
def boundary_filter(spark, sf):
    return minute_boundary(A.table(spark, sf, "events").select("event_id", "ts", "value"), "ts")


@query(
    "invalid_mask",
    f"""WITH {A.EV} SELECT event_id, CASE WHEN value - 20 > 0 THEN value - 20 END AS v,
  CASE WHEN k - 50 > 0 THEN (k - 50)::DOUBLE END AS k FROM ev""",
)
def invalid_mask(spark, sf):
    rows = A.events(spark, sf).select("event_id", (F.col("value") - 20).alias("v"), (F.col("k") - 50).alias("k"))
    return mask_invalid(to_double(rows, ["v", "k"]), ["v", "k"])


@query("regular_grid", f"WITH {A.GAPPY} SELECT event_type, time FROM grid")
def grid(spark, sf):
    return regular_grid([A.hourly(spark, sf)], ["event_type"], "time", "1 hour", "30 days")


@query("grid_reindex", f"WITH {A.GAPPY} SELECT event_type, time, v, k FROM gappy")
def grid_reindex(spark, sf):
    return A.gappy(spark, sf)


@query(
    "outer_join_series",
    f"""WITH {A.DAILY}, shipped AS (SELECT l_shipdate AS time, max(l_extendedprice) AS shipped FROM lineitem GROUP BY 1)
SELECT time, price, shipped FROM daily FULL JOIN shipped USING (time)""",
)
def outer_join(spark, sf):
    shipped = A.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("time")).agg(
        F.max("l_extendedprice").alias("shipped")
    )
    return outer_join_series(A.daily(spark, sf), shipped, [], "time")


MONTHLY = """monthly AS (
  SELECT date_trunc('month', time)::TIMESTAMP AS time, floor(round(avg(price) * 100, 6) + 0.5) / 100 AS monthly_mean
  FROM daily GROUP BY 1)"""


@query(
    "asof_join",
    f"""WITH {A.DAILY}, {MONTHLY}
SELECT l_orderkey, l_linenumber, l_shipdate AS time, m.monthly_mean
FROM lineitem l ASOF JOIN monthly m ON l.l_shipdate >= m.time""",
)
def asof(spark, sf):
    left = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("time"))
    right = monthly_mean(A.daily(spark, sf), [], "time", "price").withColumnRenamed("month", "time")
    joined = asof_join(left, right, [], "time", ["monthly_mean"], "365 days")
    return joined.select("l_orderkey", "l_linenumber", "time", "monthly_mean")


@query(
    "anti_append",
    """WITH old AS (SELECT o_orderdate AS time, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 new AS (SELECT o_orderdate AS time, max(o_totalprice) AS price FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE time NOT IN (SELECT time FROM old)""",
)
def append_new(spark, sf):
    orders = A.table(spark, sf, "orders").withColumnRenamed("o_orderdate", "time")
    by_day = lambda rows: rows.groupBy("time").agg(F.max("o_totalprice").alias("price"))
    final = F.col("o_orderstatus") == "F"
    return anti_append(by_day(orders.where(final)), by_day(orders.where(~final)), [], "time")


@query(
    "left_join_predictions",
    f"""WITH {A.FORECAST} SELECT status, time, dst_predictions, dst FROM pred LEFT JOIN obs USING (status, time)""",
)
def predictions_joined(spark, sf):
    """Per order status and line status of the same letter: a status without lines that day has a gap."""
    return left_join_predictions(A.predicted(spark, sf), A.observed(spark, sf), ["status"], "time")


@query(
    "any_data",
    f"""WITH {A.FORECAST} SELECT bool_or(dst_predictions IS NOT NULL OR dst IS NOT NULL) AS any_data FROM pred LEFT JOIN obs USING (status, time)""",
)
def has_data(spark, sf):
    return any_data(predictions_joined(spark, sf), ["dst", "dst_predictions"])


@query(
    "keyed_overlay",
    """WITH base AS (SELECT o_custkey, max(o_totalprice) AS price, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
 delta AS (SELECT o_custkey, max(o_totalprice) AS price, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT * FROM delta UNION ALL SELECT * FROM base WHERE o_custkey NOT IN (SELECT o_custkey FROM delta)""",
)
def keyed_overlay(spark, sf):
    orders = A.table(spark, sf, "orders")
    pending = F.col("o_orderstatus") == "P"
    by_customer = lambda rows: rows.groupBy("o_custkey").agg(F.max("o_totalprice").alias("price"), F.count("*").alias("n"))
    return overlay(by_customer(orders.where(~pending)), by_customer(orders.where(pending)), ["o_custkey"])


def _fill(how):
    return lambda spark, sf: fill_gaps(
        A.gappy(spark, sf).select("event_type", "time", "v"), ["event_type"], "time", ["v"], how
    )


_ORDERED = "(PARTITION BY event_type ORDER BY time ROWS BETWEEN {})"
query(
    "fill_forward",
    f"""WITH {A.GAPPY} SELECT event_type, time,
  last_value(v IGNORE NULLS) OVER {_ORDERED.format('UNBOUNDED PRECEDING AND CURRENT ROW')} AS v FROM gappy""",
)(_fill("forward"))
query(
    "fill_backward",
    f"""WITH {A.GAPPY} SELECT event_type, time,
  first_value(v IGNORE NULLS) OVER {_ORDERED.format('CURRENT ROW AND UNBOUNDED FOLLOWING')} AS v FROM gappy""",
)(_fill("backward"))
query(
    "gap_fill_full",
    f"WITH {A.GAPPY}, {A.filled_sql('v', 'gappy', 'event_type', 'f')} SELECT event_type, time, v FROM f",
)(_fill("full"))
query(
    "interp_linear",
    f"""WITH {A.GAPPY}, {A.filled_sql('v', 'gappy', 'event_type', 'f')}
SELECT event_type, time, CASE WHEN lv IS NULL AND f.v IS NOT NULL THEN NULL ELSE f.v END AS v
FROM f JOIN (SELECT event_type, time, lv FROM f_w) w USING (event_type, time)""",
)(_fill("linear"))


@query(
    "rate_of_change",
    f"""WITH {A.GAPPY} SELECT event_type, time, v,
  abs(v - lag(v) OVER (PARTITION BY event_type ORDER BY time)) AS v_roc FROM gappy""",
)
def roc(spark, sf):
    return rate_of_change(A.gappy(spark, sf).select("event_type", "time", "v"), ["event_type"], "time", ["v"])


@query(
    "outlier_mask",
    f"""WITH {A.GAPPY}, {A.masked_sql('v', 'gappy', 'event_type', 'mv')}, {A.masked_sql('k', 'gappy', 'event_type', 'mk')}
SELECT event_type, time, v, k FROM mv JOIN mk USING (event_type, time)""",
)
def outliers(spark, sf):
    return mask_outliers(A.gappy(spark, sf), ["event_type"], "time", ["v", "k"], step="1 hour")


@query(
    "outlier_mask_incremental",
    f"""WITH series AS (SELECT l_returnflag, l_shipdate AS time, max(l_extendedprice) AS price, max(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1, 2),
{A.masked_sql('price', 'series', 'l_returnflag', 'mp')}, {A.masked_sql('quantity', 'series', 'l_returnflag', 'mq')},
newest AS (SELECT date_trunc('month', max(time)) - INTERVAL 1 MONTH AS first FROM series)
SELECT l_returnflag, time, price, quantity FROM mp JOIN mq USING (l_returnflag, time), newest WHERE time >= first""",
)
def outliers_incremental(spark, sf):
    """A first run over all but the last month, wrong in the month before; then one that reads two months."""
    days = A.table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").alias("time")).agg(F.max("l_extendedprice").alias("price"), F.max("l_quantity").cast("double").alias("quantity"))
    days = staged(days, "days")
    root, keys, cols = shared_folder(spark, "rates"), ["l_returnflag"], ["price", "quantity"]
    last = F.trunc("time", "month").cast("timestamp_ntz")
    newest = days.agg(F.max(last)).scalar()
    wrong = F.when(last == newest - F.expr("INTERVAL 1 MONTH"), F.col("price") * F.dayofmonth("time")).otherwise(F.col("price"))
    update_rates(spark, root, staged(days.where(last < newest).withColumn("price", wrong), "before"), keys, "time", cols, "365 days")
    recent = staged(days.where(last >= newest - F.expr("INTERVAL 1 MONTH")), "recent")
    led = update_rates(spark, root, recent, keys, "time", cols, "365 days")
    masked = mask_outliers(led, keys, "time", cols, thresholds=published_thresholds(spark, root, keys, cols))
    return masked.where("NOT _edge").select("l_returnflag", "time", "price", "quantity")


@query(
    "mask_and_fill",
    f"""WITH {A.GAPPY}, {A.masked_sql('v', 'gappy', 'event_type', 'mv')}, {A.filled_sql('v', 'mv', 'event_type', 'f')}
SELECT event_type, time, v FROM f""",
)
def masked_filled(spark, sf):
    rows = A.gappy(spark, sf).select("event_type", "time", "v")
    return mask_and_fill(rows, ["event_type"], "time", ["v"])


@query(
    "quantile_by_series",
    """WITH s AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS rk,
    count(*) OVER (PARTITION BY l_returnflag) - 1 AS n FROM lineitem), e AS (
  SELECT l_returnflag, max(CASE WHEN rk = floor(n * 0.97::DOUBLE) THEN x END) AS lo,
    max(CASE WHEN rk = least(floor(n * 0.97::DOUBLE) + 1, n) THEN x END) AS hi,
    max(n * 0.97::DOUBLE - floor(n * 0.97::DOUBLE)) AS t FROM s GROUP BY 1)
SELECT l_returnflag, round(CASE WHEN t >= 0.5 THEN hi - (hi - lo) * (1 - t) ELSE lo + (hi - lo) * t END, 6) AS l_extendedprice FROM e""",
)
def quantile(spark, sf):
    out = quantiles(A.table(spark, sf, "lineitem"), ["l_returnflag"], ["l_extendedprice"], 0.97)
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query(
    "pressure_round",
    f"""WITH {A.EV} SELECT event_id, round_even(1.6726e-27::DOUBLE * (k / 4.0::DOUBLE) * 1e6::DOUBLE *
  ((300.0::DOUBLE + value) * (300.0::DOUBLE + value)) * 1e6::DOUBLE * 1e9::DOUBLE * 100, 0) / 100 AS pressure FROM ev""",
)
def pressure(spark, sf):
    p = dynamic_pressure(F.col("k") / F.lit(4.0), F.lit(300.0) + F.col("value"))
    return A.events(spark, sf).select("event_id", round_half_even(p).alias("pressure"))


@query(
    "normalise_features",
    f"""WITH {A.EV} SELECT event_id, ((300.0::DOUBLE + value) - 410.43::DOUBLE) / 128.55::DOUBLE AS speed,
  (k / 4.0::DOUBLE - 3.19466::DOUBLE) / 3.8::DOUBLE AS density FROM ev""",
)
def normalised(spark, sf):
    rows = A.events(spark, sf).select("event_id", (F.lit(300.0) + F.col("value")).alias("speed"), (F.col("k") / F.lit(4.0)).alias("density"))
    return rows.select("event_id", normalise("speed").alias("speed"), normalise("density").alias("density"))


@query("denormalise", "SELECT event_id, value * 19.0::DOUBLE + (-8.0)::DOUBLE AS v FROM events")
def denormalised(spark, sf):
    return A.table(spark, sf, "events").select("event_id", denormalise(F.col("value")).alias("v"))


@query("select_columns", "SELECT o_orderdate AS time, o_totalprice AS price, o_custkey FROM orders")
def select_columns(spark, sf):
    rows = A.table(spark, sf, "orders").withColumnsRenamed({"o_orderdate": "time", "o_totalprice": "price"})
    return project(rows.drop("o_orderpriority"), ["time", "price", "o_custkey"])


@query("chart_points", f"WITH {A.GAPPY} SELECT event_type, epoch_ms(time) AS ms, v AS value FROM gappy")
def charted(spark, sf):
    return chart_points(A.gappy(spark, sf), "v", keys=["event_type"])


@query(
    "clean_index",
    f"""WITH {A.DAILY}, raw AS (SELECT time, CASE WHEN price >= 200000 THEN price END AS price FROM daily),
 {A.filled_sql('price', 'raw', '', 'f')} SELECT time, price FROM f""",
)
def index_series(spark, sf):
    raw = A.daily(spark, sf).select(
        F.date_format("time", "yyyy-MM-dd").alias("Obsdate"), F.when(F.col("price") >= 200000, F.col("price")).alias("price")
    )
    return clean_index(raw, "Obsdate", ["price"])


@query("tail_n", f"WITH {A.DAILY} SELECT time, price FROM daily ORDER BY time DESC LIMIT 365")
def tail_n(spark, sf):
    return tail_rows(A.daily(spark, sf), 365, "time")


@query("tail_n_long", "SELECT l_shipdate, l_linenumber, l_orderkey FROM lineitem ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 4383")
def tail_n_long(spark, sf):
    """The newest 4,383 rows, as the sunspot cycle keeps; one long whole number stands for the time and its ties."""
    rows = A.table(spark, sf, "lineitem").select("l_shipdate", "l_linenumber", "l_orderkey")
    at = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * (1 << 40) + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return tail_rows(rows.withColumn("at", at), 4383, "at").drop("at")


@query(
    "tail_n_hot",
    """SELECT event_type = 'view' AS hot, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type = 'view' ORDER BY ts DESC) <= 5000""",
)
def tail_n_hot(spark, sf):
    """Two series, one of them with most of the rows; narrow buckets."""
    rows = A.table(spark, sf, "events").select((F.col("event_type") == "view").alias("hot"), "ts", "event_id")
    return tail_rows(rows, 5000, "ts", ["hot"], "1 day")


@query(
    "quantile_narrow",
    """SELECT event_type, round(quantile_cont(101325.0::DOUBLE + (event_id % 100003)::DOUBLE / 8192, 0.97), 6) AS pressure FROM events GROUP BY 1""",
)
def quantile_narrow(spark, sf):
    """A column whose values differ by little against their size: one coarse bin, many fine ones."""
    rows = A.table(spark, sf, "events").select("event_type", (F.lit(101325.0) + (F.col("event_id") % 100003) / F.lit(8192.0)).alias("pressure"))
    return quantiles(rows, ["event_type"], ["pressure"], 0.97).withColumn("pressure", F.round("pressure", 6))


@query(
    "tail_n_by_series",
    f"""WITH {A.HOURLY} SELECT event_type, time, v, k FROM hourly
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY time DESC) <= 100""",
)
def tail_by_series(spark, sf):
    return tail_rows(A.hourly(spark, sf), 100, "time", ["event_type"])


# ---- the solar job over events: two feeds, each with its own active window and missing values ----

_SOURCES = {"signup": "SOLAR1", "purchase": "IMAP", "click": "ACE", "view": "DSCOVR", "error": "OTHER"}


def _feed(spark, sf, active, cols):
    ev = A.events(spark, sf).withColumn("_minute", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:'00'"))
    source = F.element_at(F.create_map(*[F.lit(x) for p in _SOURCES.items() for x in p]), F.col("event_type"))
    rows = ev.select(F.col("_minute").alias("time_tag"), active.alias("active"), source.alias("source"), "event_id", *cols)
    return A.last_wins(rows, ["time_tag", "source"], "event_id").drop("event_id")


def solar_feeds(spark, sf):
    value, k, minute = F.col("value"), F.col("k"), F.minute("ts")
    mag = _feed(
        spark, sf, minute < 40,
        [
            F.when(k >= 10, value / 10.0 - 5.0).alias("bz_gsm"),
            F.when(k >= 10, k / F.lit(10.0)).alias("bx_gsm"),
            F.when(k >= 10, (k - 50) / F.lit(4.0)).alias("by_gsm"),
            F.when(k >= 10, value).alias("bt"),
        ],
    )
    plasma = _feed(
        spark, sf, minute >= 20,
        [
            F.when(value >= 10, value + 300.0).alias("proton_speed"),
            F.when(value >= 10, value * 1000.0).alias("proton_temperature"),
            F.when(value >= 5, (k - 10) / F.lit(5.0)).alias("proton_density"),
        ],
    )
    return mag, plasma


def _select_sql(out, active, cols):
    """CTE `out`: one row per minute from the events feed with the given active rule and columns."""
    raw = ", ".join(f"{e} AS {c}" for c, e in cols.items())
    names = list(cols)
    picks = ", ".join(
        f"arg_min({c}, prio) FILTER (WHERE active AND {c} IS NOT NULL) AS a_{c}, "
        f"arg_min({c}, prio) FILTER (WHERE NOT active AND {c} IS NOT NULL) AS i_{c}" for c in names
    )
    full = " AND ".join(f"{c} IS NOT NULL" for c in names)
    empty = " AND ".join(f"a_{c} IS NULL" for c in names)
    final = ", ".join(f"CASE WHEN NOT ha OR ({empty} AND iv) THEN i_{c} ELSE a_{c} END AS {c}" for c in names)
    return f"""{out}_raw AS (SELECT date_trunc('minute', ts) AS time, {active} AS active, {raw},
    CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 999 END AS prio
  FROM ev QUALIFY row_number() OVER (PARTITION BY date_trunc('minute', ts), event_type ORDER BY event_id DESC) = 1), {out}_g AS (
  SELECT time, bool_or(active) AS ha, bool_or(NOT active AND {full}) AS iv, {picks} FROM {out}_raw GROUP BY time), {out} AS (
  SELECT time, {final} FROM {out}_g)"""


_MAG = {
    "bz": "CASE WHEN k >= 10 THEN value / 10.0::DOUBLE - 5.0::DOUBLE END",
    "bx": "CASE WHEN k >= 10 THEN k / 10.0::DOUBLE END",
    "by": "CASE WHEN k >= 10 THEN (k - 50) / 4.0::DOUBLE END",
    "bt": "CASE WHEN k >= 10 THEN value END",
}
_PLASMA = {
    "speed": "CASE WHEN value >= 10 THEN value + 300.0::DOUBLE END",
    "temperature": "CASE WHEN value >= 10 THEN value * 1000.0::DOUBLE END",
    "density": "CASE WHEN value >= 5 THEN (k - 10) / 5.0::DOUBLE END",
}
_MINUTE = "extract('minute' FROM ts)"
_VALUES = ["speed", "temperature", "density", "bz", "bx", "by", "bt"]


def solar_ctes():
    # "by" is a keyword in SQL, so the oracle calls that column b_y until the end.
    mag = {("b_y" if c == "by" else c): e for c, e in _MAG.items()}
    names = ["b_y" if c == "by" else c for c in _VALUES]
    parts = [A.EV, _select_sql("mag", f"{_MINUTE} < 40", mag), _select_sql("plasma", f"{_MINUTE} >= 20", _PLASMA)]
    valid = ", ".join(f"CASE WHEN p.{c} > 0 THEN p.{c} END AS {c}" for c in ("speed", "temperature", "density"))
    parts.append(
        f"""span AS (SELECT min(t) AS lo, max(t) AS hi FROM (SELECT time AS t FROM mag UNION ALL SELECT time FROM plasma)),
 minutes AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MINUTE)) AS time FROM span),
 joined AS (SELECT t.time, {valid}, m.bz, m.bx, m.b_y, m.bt
  FROM minutes t LEFT JOIN plasma p ON t.time = p.time LEFT JOIN mag m ON t.time = m.time)"""
    )
    for c in names:
        parts.append(A.masked_sql(c, "joined", "", f"m_{c}"))
        parts.append(A.filled_sql(c, f"m_{c}", "", f"f_{c}"))
    joins = " ".join(f"JOIN f_{c} USING (time)" for c in names[1:])
    two = lambda e: f"round_even(({e}) * 100, 0) / 100"
    press = (
        "1.6726e-27::DOUBLE * density * 1e6::DOUBLE * (speed * speed) * 1e6::DOUBLE * 1e9::DOUBLE"
    )
    cols = ", ".join(f"{two(c)} AS {c}" for c in names)
    parts.append(f"solar AS (SELECT time, {cols}, {two(press)} AS pressure FROM f_{names[0]} {joins})")
    return ", ".join(parts)


@query(
    "solar_series",
    f"""WITH {solar_ctes()} SELECT time, speed, temperature, density, bz, bx, b_y AS "by", bt, pressure FROM solar""",
)
def solar_series(spark, sf):
    return clean_solar(*solar_feeds(spark, sf))


def _smoothed(spark, sf):
    return A.events(spark, sf).groupBy(floor_time(F.col("ts"), "week").alias("time")).agg(F.max("value").alias("predicted_ssn"))


def _feature_sql():
    names = {"by": "b_y"}
    norm = ", ".join(
        f"({names.get(c, c)} - ({m})::DOUBLE) / ({s})::DOUBLE AS {names.get(c, c)}" for c, (m, s) in FEATURE_STATS.items()
    )
    out = ", ".join(
        f"""round({fn}({names.get(c, c)}), 6) AS "{c}_{suffix}\""""
        for c in FEATURE_STATS
        for suffix, fn in (("mean", "avg"), ("std", "stddev_samp"))
        if (c, suffix) != ("predicted_ssn", "std")
    )
    return f"""WITH {solar_ctes()}, weekly AS (
  SELECT date_trunc('week', ts)::TIMESTAMP AS time, max(value) AS predicted_ssn FROM ev GROUP BY 1), j AS (
  SELECT s.*, w.predicted_ssn FROM solar s ASOF JOIN weekly w ON s.time >= w.time), n AS (
  SELECT time, {norm} FROM j WHERE speed IS NOT NULL)
SELECT date_trunc('hour', time) AS time, {out} FROM n GROUP BY 1 HAVING count(speed) = 60"""


def _features(spark, sf):
    solar = staged(solar_series(spark, sf), "solar")
    return prepare_features(solar, _smoothed(spark, sf), emit_empty=False)


_DAY = 24


@query(
    "solar_predictions",
    f"""WITH {solar_ctes()}, hours AS (
  SELECT date_trunc('hour', time) AS time, avg((speed - 410.43::DOUBLE) / 128.55::DOUBLE) AS v FROM solar
  WHERE time >= (SELECT date_trunc('week', min(ts)) FROM ev) GROUP BY 1 HAVING count(speed) = 60), q AS (
  SELECT time, list(v) OVER (ORDER BY time ROWS BETWEEN {_DAY - 1} PRECEDING AND CURRENT ROW) AS vs FROM hours)
SELECT time + INTERVAL 1 HOUR AS time, round(list_sum(vs) / {_DAY} * 19 - 8, 2) AS dst_predictions FROM q WHERE len(vs) = {_DAY}""",
)
def solar_predictions(spark, sf):
    """Raw feeds to predictions, with a scorer that averages the last day of normalised speed."""
    weights = np.zeros((_DAY, len(FEATURE_COLS)))
    weights[:, FEATURE_COLS.index("speed_mean")] = 1.0 / _DAY
    return predict(staged(_features(spark, sf), "features"), LinearScorer(weights), length=_DAY)


@query("feature_table", _feature_sql())
def feature_table(spark, sf):
    features = _features(spark, sf)
    return features.select("time", *[F.round(c, 6).alias(c) for c in FEATURE_COLS])
