
import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import land, land_partitioned, land_single, last_wins, merge_records
from tidemark.operators.publish import change_feed, delta_merge, diff_upsert, feed_silence, latest_snapshot, publish, slice_interval, sync_marker, table_health
from tidemark.plans import views
from tidemark.sources.tables import list_partitions, read_last_partitions, read_legacy, read_or_empty

RAW = "time_tag STRING, source STRING, v DOUBLE, seq INT"


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def test_last_wins_keeps_whole_records(frame):
    df = frame(RAW, [("a", "x", 1.0, 1), ("a", "x", None, 2), ("b", "x", 3.0, 1)])
    assert {r.time_tag: r.v for r in last_wins(df, ["time_tag", "source"], "seq").collect()} == {"a": None, "b": 3.0}


def test_merge_new_beats_old(frame):
    old = frame("k STRING, v DOUBLE", [("a", 1.0), ("b", 2.0)])
    new = frame("k STRING, v DOUBLE, seq INT", [("b", 8.0, 1), ("b", 9.0, 2), ("c", 3.0, 1)])
    assert {r.k: r.v for r in merge_records(old, new, ["k"], "seq").collect()} == {"a": 1.0, "b": 9.0, "c": 3.0}


def landed(spark, path):
    return sorted((r.time_tag, r.source, r.v) for r in spark.read.parquet(path).collect())


def test_partitioned_landing(spark, frame, tmp_path):
    path = str(tmp_path / "raw")
    keys = ["time_tag", "source"]
    first = frame(RAW, [("2026-01-31T23:59:00", "A", 1.0, 1), ("2026-02-01T00:00:00", "A", 2.0, 2), ("2026-03-01T00:00:00", "A", 3.0, 3)])
    assert land_partitioned(spark, path, first, keys, "time_tag", "seq") == ["2026-01", "2026-02", "2026-03"]
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "raw" / "month=2026-01").iterdir()}
    second = frame(RAW, [("2026-02-01T00:00:00", "A", None, 1), ("2026-02-01T00:00:00", "B", 7.0, 2)])
    for _ in range(2):  # landing the same payload again changes nothing
        assert land_partitioned(spark, path, second, keys, "time_tag", "seq") == ["2026-02"]
        assert landed(spark, path) == [
            ("2026-01-31T23:59:00", "A", 1.0), ("2026-02-01T00:00:00", "A", None), ("2026-02-01T00:00:00", "B", 7.0), ("2026-03-01T00:00:00", "A", 3.0),
        ]
    assert untouched == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "raw" / "month=2026-01").iterdir()}
    assert list_partitions(spark, path, "month") == ["2026-01", "2026-02", "2026-03"]
    assert sorted(r.time_tag[:7] for r in read_last_partitions(spark, path, 2).collect()) == ["2026-02", "2026-02", "2026-03"]
    assert read_last_partitions(spark, path, None).count() == 4
    plan = read_last_partitions(spark, path, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_column_pruning_and_single_landing(spark, frame, tmp_path):
    path = str(tmp_path / "single")
    rows = frame(RAW, [("2026-01", "A", 1.0, 1)])
    land(spark, path, rows, ["time_tag"], "time_tag", False, keep=["time_tag", "v"])
    land_single(spark, path, frame("time_tag STRING, v DOUBLE", [("2026-01", 5.0), ("2026-02", 6.0)]), ["time_tag"])
    assert [(r.time_tag, r.v) for r in spark.read.parquet(path).orderBy("time_tag").collect()] == [("2026-01", 5.0), ("2026-02", 6.0)]
    assert land(spark, path, None, ["time_tag"], "time_tag", True) == []
    part = str(tmp_path / "part")
    land(spark, part, frame(RAW, [("2026-01-01", "A", 1.0, 1)]), ["time_tag", "source"], "time_tag", True, "seq", ["time_tag", "source", "v"])
    assert sorted(spark.read.parquet(part).columns) == ["month", "source", "time_tag", "v"]


def test_absent_and_legacy_tables(spark, tmp_path):
    schema = spark.createDataFrame([("a",)], "time_tag string").schema
    assert read_or_empty(spark, str(tmp_path / "none"), schema).columns == ["time_tag"]
    assert read_legacy(spark, str(tmp_path / "none"), schema, True).isEmpty()


SERVED = "time TIMESTAMP_NTZ, a DOUBLE, b DOUBLE"


def test_diff_upsert_moves_updated_at_only_for_changes(frame):
    base = frame(SERVED, [("2026-01-01", 1.0, None), ("2026-01-02", 2.0, 2.0), ("2026-01-03", 3.0, 3.0)]).withColumn("updated_at", stamp("2026-02-01"))
    delta = frame(SERVED, [("2026-01-01", 1.0, None), ("2026-01-02", 2.0, None), ("2026-01-04", 4.0, 4.0)])
    once = diff_upsert(base, delta, ["time"], ["a", "b"], stamp("2026-03-01"), changed_flag=True)
    assert [(r.time.day, r.b, r.updated_at.month, r._changed) for r in once.orderBy("time").collect()] == [
        (1, None, 2, False), (2, None, 3, True), (3, 3.0, 2, False), (4, 4.0, 3, True),
    ]
    again = diff_upsert(once.drop("_changed"), delta, ["time"], ["a", "b"], stamp("2026-04-01"))
    assert again.where("month(updated_at) = 4").isEmpty()


def test_publish_trims_and_is_idempotent(spark, frame, tmp_path):
    path = str(tmp_path / "solar")
    first = frame(SERVED, [("2025-01-15", 0.0, 0.0), ("2025-02-10", 1.0, 1.0), ("2025-02-20", 2.0, 2.0), ("2026-01-31", 3.0, 3.0)])
    publish(spark, path, first, ["time"], ["a", "b"], stamp("2026-02-01"))
    more = frame(SERVED, [("2026-01-31", 3.0, 3.0), ("2026-02-15", 4.0, 4.0)])
    for _ in range(2):
        publish(spark, path, more, ["time"], ["a", "b"], stamp("2026-02-16"), keep="1 year")
        out = spark.read.parquet(path).orderBy("time").collect()
        assert [(str(r.time.date()), str(r.updated_at.date())) for r in out] == [
            ("2025-02-20", "2026-02-01"), ("2026-01-31", "2026-02-01"), ("2026-02-15", "2026-02-16"),
        ]
    assert list_partitions(spark, path, "month") == ["2025-02", "2026-01", "2026-02"]
    sync_marker(spark, str(tmp_path / "meta"), stamp("2026-02-16"))
    sync_marker(spark, str(tmp_path / "meta"), stamp("2026-02-17"))
    assert [r.last_synced.day for r in spark.read.parquet(str(tmp_path / "meta")).collect()] == [17]


def test_publish_of_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "empty")
    nothing = frame(SERVED, [("2026-01-01", 1.0, 1.0)]).where("false")
    publish(spark, path, nothing, ["time"], ["a", "b"], stamp("2026-02-01"), keep="1 year")
    assert list_partitions(spark, path, "month") == []
    publish(spark, path, frame(SERVED, [("2026-01-01", 1.0, 1.0)]), ["time"], ["a", "b"], stamp("2026-02-01"))
    publish(spark, path, nothing, ["time"], ["a", "b"], stamp("2026-03-01"), keep="1 year")
    assert spark.read.parquet(path).count() == 1


def test_change_feed_and_delta_merge(frame):
    table = frame(SERVED, [("2026-01-01", 1.0, 1.0), ("2026-03-01", 2.0, 2.0), ("2026-03-02", 3.0, 3.0)]).withColumn(
        "updated_at", F.when(F.col("a") == 3, stamp("2026-03-05")).otherwise(stamp("2026-03-04"))
    )
    assert change_feed(table, None).count() == 3 and change_feed(table, None, held_days=31).count() == 2
    assert [r.a for r in change_feed(table, stamp("2026-03-04")).collect()] == [3.0]
    assert change_feed(table, stamp("2026-03-05"), overlap="2 days").count() == 3
    held = table.drop("updated_at").where("a < 3")
    delta = frame(SERVED, [("2025-12-01", 9.0, 9.0), ("2026-03-02", 3.0, 3.0)])
    state, changed = delta_merge(held, delta, ["time"], "time", 31)
    assert sorted(r.a for r in state.collect()) == [2.0, 3.0] and [r.time.day for r in changed.collect()] == [2]


@pytest.mark.parametrize("span, first", [("24 hours", "2026-03-30"), ("7 days", "2026-03-24"), ("1 month", "2026-02-28"), ("1 year", "2025-03-31")])
def test_slices_anchor_on_the_newest_row(frame, span, first):
    days = frame("time TIMESTAMP_NTZ", [("2025-03-30",), ("2025-03-31",), ("2026-02-27",), ("2026-02-28",), ("2026-03-23",), ("2026-03-24",), ("2026-03-30",), ("2026-03-31",)])
    assert str(slice_interval(days, "time", span).agg(F.min("time")).first()[0].date()) == first
    assert slice_interval(days.where("false"), "time", span).isEmpty()


def test_health_and_silence(frame):
    full = frame("updated_at TIMESTAMP_NTZ", [("2026-01-01",)])
    out = table_health({"a": full, "b": full.where("false")}).orderBy("table").collect()
    assert [(r.table, r.rows, r.status) for r in out] == [("a", 1, "warming_up"), ("b", 0, "warming_up")]
    assert table_health({"a": full}).first().status == "ok"
    log = frame("feed STRING, at TIMESTAMP_NTZ, ok BOOLEAN", [("a", "2026-01-01 10:00:00", True), ("a", "2026-01-01 11:30:00", False), ("b", "2026-01-01 11:30:00", True), ("c", "2026-01-01 11:59:00", False)])
    silent = {r.feed: r.silent for r in feed_silence(log, "feed", "at", "ok", stamp("2026-01-01 12:00:00")).collect()}
    assert silent == {"a": True, "b": False, "c": True}


def test_latest_snapshot_replaces_whole(frame):
    df = frame("p STRING, retrieved_at TIMESTAMP_NTZ, v INT", [("a", "2026-01-01", 1), ("a", "2026-01-02", 2), ("a", "2026-01-02", 3), ("b", "2026-01-01", 4)])
    assert sorted(r.v for r in latest_snapshot(df, ["p"], "retrieved_at").collect()) == [2, 3, 4]


SOLAR = "time TIMESTAMP_NTZ, density DOUBLE, speed DOUBLE, temperature DOUBLE, bz DOUBLE, bx DOUBLE, by DOUBLE, bt DOUBLE, pressure DOUBLE"


def test_views(frame):
    solar = frame(SOLAR, [("2026-01-01", 1.0, 400.0, 5000.0, -1.0, 0.0, 0.0, 1.0, 1.0), ("2026-01-03", 2.0, 610.0, 9000.0, -12.0, 0.0, 0.0, 1.0, 2.0)])
    assert views.solar_raw(solar, "24h").count() == 1 and views.solar_raw(solar, "7d", ["bz"]).columns == ["time", "bz"]
    with pytest.raises(ValueError, match="unknown columns"):
        views.solar_latest(solar, ["nope"])
    with pytest.raises(ValueError, match="unknown interval"):
        views.solar_raw(solar, "1mo")
    assert views.solar_latest(solar.where("false")).isEmpty()
    assert views.chart_temperature(solar).orderBy("time").first().temperature == 5.0
    dst = frame("time TIMESTAMP_NTZ, dst DOUBLE", [("2026-01-02", -60.0)])
    pred = frame("time TIMESTAMP_NTZ, dst_predictions DOUBLE", [("2026-01-02", -50.0), ("2026-01-03", -55.0), ("2025-01-03", -5.0)])
    merged = views.dst_merged(pred, dst).orderBy("time").collect()
    assert [(r.dst_predictions, r.dst) for r in merged] == [(-50.0, -60.0), (-55.0, None)]
    assert views.any_data(views.dst_merged(pred, dst), ["dst", "dst_predictions"]).first().any_data
    kp = frame("time TIMESTAMP_NTZ, Kp DOUBLE", [("2026-01-02", 7.33)])
    grid = frame(
        "observation_time STRING, forecast_time STRING, retrieved_at TIMESTAMP_NTZ, lon INT, lat INT, value INT",
        [("o", "f", "2026-01-01", 10, 70, 99), ("o2", "f2", "2026-01-02", 350, 70, 55), ("o2", "f2", "2026-01-02", 10, 5, 90), ("o2", "f2", "2026-01-02", 20, -70, 1)],
    )
    points, summary = views.nowcast(grid)
    assert [(r.lon, r.value) for r in points.collect()] == [(-10, 55)]
    cards = {r.reading: (r.value, r.severity, r.band) for r in views.current_conditions(solar, dst, kp, summary).collect()}
    assert cards == {
        "speed": (610.0, "severe", None), "bz": (-12.0, "moderate", None), "dst": (-60.0, "moderate", None),
        "Kp": (7.33, "severe", 3), "max_value": (55.0, "moderate", None),
    }
    quiet = views.nowcast(grid.withColumn("value", F.lit(0)))[1].first()
    assert (quiet.point_count, quiet.max_value) == (0, 0) and views.nowcast(grid.where("false"))[1].isEmpty()


def test_chart_points_keep_nulls(frame):
    df = frame("time TIMESTAMP_NTZ, v DOUBLE", [("1970-01-01 00:00:01", None), ("1970-01-01 00:00:02", 0.0)])
    assert [tuple(r) for r in views.chart_points(df, "v").orderBy("ms").collect()] == [(1000, None), (2000, 0.0)]
