import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import FEATURE_STATS, denormalise, dynamic_pressure, lookup, normalise, round_half_even, round_mean, wrap_longitude
from tidemark.functions.severity import AURORA, BZ, DST, KP, SPEED, band, classify
from tidemark.functions.timeparts import epoch_seconds, floor_time, from_epoch_seconds, parse_time
from tidemark.operators.buckets import complete_bucket_mean, complete_bucket_stats, monthly_mean, prune_buckets, recompute_touched
from tidemark.operators.clean import mask_invalid, minute_boundary, project, to_double, with_time_key
from tidemark.operators.grid import anti_append, left_join_predictions, outer_join_series, overlay, regular_grid, reindex


def column(spark, ddl, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_minute_boundary(frame):
    df = frame("t TIMESTAMP_NTZ", [("2026-01-01 00:00:02",), ("2026-01-01 00:00:00",)])
    assert minute_boundary(df, "t").count() == 1


def test_invalid_mask(spark):
    df = spark.createDataFrame([(-3.4,), (0.0,), (5.0,), (None,)], "density double")
    assert [r[0] for r in mask_invalid(df, ["density"]).collect()] == [None, None, 5.0, None]


def test_cast_strict_and_lenient(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",)], "a string")
    assert [r[0] for r in to_double(df, ["a"], strict=False).collect()] == [1.5, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        to_double(df, ["a"]).collect()


def test_time_key(spark):
    texts = ["2026-01-01T02:03:00", "2026-01-01", "2026-01", "2026-01-01 02:03:00", "2026-01-01T02:03:00Z", "junk"]
    out = column(spark, "t string", [(t,) for t in texts], parse_time(F.col("t"), strict=False).cast("string"))
    assert out == ["2026-01-01 02:03:00", "2026-01-01 00:00:00", "2026-01-01 00:00:00"] + ["2026-01-01 02:03:00"] * 2 + [None]
    df = spark.createDataFrame([("2026-01-01", 1.0)], "`time-tag` string, v double")
    assert with_time_key(df, "time-tag").columns == ["time", "v"]


def test_time_arithmetic_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:45' t")  # skipped by the zone's clock change
        row = df.select(
            floor_time(F.col("t"), "hour").cast("string"), from_epoch_seconds(epoch_seconds(F.col("t"))).cast("string")
        ).first()
        assert tuple(row) == ("2024-03-10 02:00:00", "2024-03-10 02:30:45")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rounding(spark):
    xs = [2.675, 0.125, 0.135, 1.005, 23.5678]
    assert column(spark, "x double", [(x,) for x in xs], round_half_even(F.col("x"))) == [2.68, 0.12, 0.14, 1.0, 23.57]
    noisy = column(spark, "x double", [(44.755,), (44.75500000000001,)], round_mean(F.col("x")))
    assert noisy == [44.76, 44.76]
    assert column(spark, "x double", [(0.125,)], round_mean(F.col("x"), half_up=True)) == [0.13]


def test_pressure(spark):
    out = column(spark, "d double, s double", [(5.0, 400.0)], round_half_even(dynamic_pressure(F.col("d"), F.col("s"))))
    assert out == [round(1.6726e-27 * 5 * 1e6 * 400**2 * 1e6 * 1e9, 2)]


def test_normalise_and_back(spark):
    ddl = ", ".join(f"`{c}` double" for c in FEATURE_STATS)
    df = spark.createDataFrame([tuple(m for m, _ in FEATURE_STATS.values())], ddl)
    assert set(df.select(*[normalise(c).alias(c) for c in FEATURE_STATS]).first()) == {0.0}
    assert column(spark, "p double", [(0.0,), (1.0,), (-1.0,)], denormalise(F.col("p"))) == [-8.0, 11.0, -27.0]


def test_lookup_and_wrap(spark):
    assert column(spark, "s string", [("ACE",), ("?",)], lookup({"ACE": 2}, F.col("s"), 999)) == [2, 999]
    assert column(spark, "l int", [(0,), (180,), (181,), (359,)], wrap_longitude(F.col("l"))) == [0, 180, -179, -1]


@pytest.mark.parametrize(
    "bounds, rising, cases",
    [
        (KP, True, {8.0: "extreme", 7.0: "severe", 5.0: "moderate", 4.0: "minor", 3.99: "quiet"}),
        (DST, False, {-200.0: "extreme", -100.0: "severe", -50.0: "moderate", -30.0: "minor", -29.0: "quiet"}),
        (SPEED, True, {600.0: "severe", 500.0: "moderate", 450.0: "minor", 449.0: "quiet"}),
        (BZ, False, {-20.0: "severe", -10.0: "moderate", -5.0: "minor", 0.0: "quiet"}),
        (AURORA, True, {80.0: "severe", 50.0: "moderate", 49.0: "quiet"}),
    ],
)
def test_severity(spark, bounds, rising, cases):
    out = column(spark, "x double", [(x,) for x in cases] + [(None,)], classify(F.col("x"), bounds, rising))
    assert out == [*cases.values(), None]


def test_gauge_band(spark):
    xs = [0.0, 3.9, 4.0, 5.0, 7.0, 8.0, 9.0, 9.1, -1.0]
    assert column(spark, "x double", [(x,) for x in xs], band(F.col("x"))) == [0, 0, 1, 2, 3, 4, 4, None, None]


def minutes(frame, rows, col):
    return frame(f"time TIMESTAMP_NTZ, {col} DOUBLE", [(f"2026-01-01 00:0{m}:00", v) for m, v in rows])


def test_grid_covers_both_inputs(frame):
    a, b = minutes(frame, [(1, 1.0), (3, 3.0)], "a"), minutes(frame, [(2, 2.0), (5, 5.0)], "b")
    out = reindex([a, b], [], "time").orderBy("time").collect()
    assert [(r.time.minute, r.a, r.b) for r in out] == [
        (1, 1.0, None), (2, None, 2.0), (3, 3.0, None), (4, None, None), (5, None, 5.0)
    ]
    off = frame("time TIMESTAMP_NTZ, c DOUBLE", [("2026-01-01 00:02:30", 1.0)])
    assert reindex([a, off], [], "time").where("c is not null").isEmpty()


def test_grid_of_a_long_series_is_cut_into_chunks(frame):
    ends = frame("k STRING, time TIMESTAMP_NTZ", [("a", "2020-01-01 00:00:30"), ("a", "2020-12-31 23:59:00"), ("b", "2020-01-01")])
    grid = regular_grid([ends], ["k"], "time")
    counts = {r.k: r["count"] for r in grid.groupBy("k").count().collect()}
    assert counts == {"a": 366 * 1440, "b": 1} and grid.distinct().count() == 366 * 1440 + 1


def test_joins(frame):
    old, new = minutes(frame, [(1, 1.0), (2, 2.0)], "v"), minutes(frame, [(2, 9.0), (3, 3.0)], "v")
    kept = {r.time.minute: r.v for r in anti_append(old, new, [], "time").collect()}
    assert kept == {1: 1.0, 2: 2.0, 3: 3.0}
    assert {r.time.minute: r.v for r in overlay(old, new, ["time"]).collect()} == {1: 1.0, 2: 9.0, 3: 3.0}
    wide = outer_join_series(old, new.withColumnRenamed("v", "w"), [], "time")
    assert wide.columns == ["time", "v", "w"] and wide.count() == 3
    left = left_join_predictions(new, old.withColumnRenamed("v", "dst"), [], "time").orderBy("time").collect()
    assert [(r.v, r.dst) for r in left] == [(9.0, 2.0), (3.0, None)]


def test_overlay_delta_null_wins(frame):
    base, delta = minutes(frame, [(1, 1.0)], "v"), minutes(frame, [(1, None)], "v")
    assert overlay(base, delta, ["time"]).first().v is None


def test_project_lists_unknown_columns(spark):
    with pytest.raises(ValueError, match=r"unknown columns: \['x', 'y'\]"):
        project(spark.createDataFrame([(1,)], "a int"), ["y", "a", "x"])


def hour_rows(spark, hours):
    """(hour, minutes present) pairs to minute rows with v = minute."""
    base = F.lit("2026-01-01").cast("timestamp_ntz")
    rows = spark.createDataFrame([(h, m) for h, n in hours for m in range(n)], "h int, m int")
    return rows.select((base + F.make_dt_interval(F.lit(0), F.col("h"), F.col("m"))).alias("time"), F.col("m").cast("double").alias("v"))


def test_complete_hours_only(spark):
    rows = hour_rows(spark, [(0, 60), (1, 59), (3, 60)])
    out = complete_bucket_mean(rows, [], "time", ["v"]).orderBy("time").collect()
    assert [(r.time.hour, r.v) for r in out] == [(0, 29.5), (3, 29.5)]
    stats = complete_bucket_stats(rows, [], "time", ["v"], emit_empty=True).orderBy("time").collect()
    assert [(r.time.hour, r.v_mean) for r in stats] == [(0, 29.5), (1, None), (2, None), (3, 29.5)]
    assert math.isclose(stats[0].v_std, 17.464249196572979)


def test_repeated_minutes_do_not_complete_an_hour(spark):
    rows = hour_rows(spark, [(0, 59)])
    assert complete_bucket_mean(rows.unionByName(rows.limit(1)), [], "time", ["v"]).isEmpty()


def test_touched_hours_and_pruning(spark):
    before = hour_rows(spark, [(0, 60), (1, 60), (2, 60)])
    published = complete_bucket_mean(before, [], "time", ["v"])
    lost = F.lit("2026-01-01 01:30:00").cast("timestamp_ntz")
    base = before.where(F.col("time") != lost)
    changed = before.where(F.col("time") == lost).select("time")
    out = recompute_touched(base, changed, published, [], "time", ["v"])
    assert sorted(r.time.hour for r in out.collect()) == [0, 2]
    held = before.where(F.hour("time") >= 2)
    assert [r.time.hour for r in prune_buckets(published, held, "time").collect()] == [2]


def test_monthly_mean_rounds_half_up_and_skips_null(frame):
    df = frame("time TIMESTAMP_NTZ, s DOUBLE", [("2026-01-01", 0.12), ("2026-01-02", 0.13), ("2026-01-03", None), ("2026-02-01", 3.0)])
    assert [r.monthly_mean for r in monthly_mean(df, [], "time", "s").orderBy("month").collect()] == [0.13, 3.0]
