"""Landing order and rejects, series that lag, pruned views, weeks across months, hot bins, clean-up."""

import bisect
import json
import os
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.timeparts import bad_times, parse_time
from tidemark.operators.asof import asof_join, asof_slow
from tidemark.operators.buckets import complete_bucket_stats
from tidemark.operators.carry import tail_rows
from tidemark.operators.merge import land_documents, last_wins, merge_records
from tidemark.operators.publish import change_feed, delta_merge, publish, retention_trim, slice_published, upsert_lookback
from tidemark.operators.quantile import quantiles
from tidemark.operators.select_source import select_source
from tidemark.operators.sequences import LinearScorer, score_sequences
from tidemark.plans import views
from tidemark.plans.jobs import land_feeds, land_grid, land_legacy, read_raw, refresh_served
from tidemark.session import shared_folder, workspace
from tidemark.sources.payloads import dict_rows, grid_rows, list_rows, nested_samples, parallel_rows, payload_rejects, read_documents
from tidemark.streaming.incremental import refresh_buckets


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def put(folder, name, payload, age=0):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
    os.utime(path, (time.time() - age, time.time() - age))


def test_malformed_documents_are_listed_and_raise(spark):
    cut = json.dumps([{"t": "a", "v": 1.0}])[:-2]
    docs = spark.createDataFrame([(0, cut), (1, '[["t","v"],["a"'), (2, "{}"), (3, None), (4, '[{"t":"b","v":2}]')], "id int, payload string")
    assert {r.id: r.reason for r in payload_rejects(docs, "payload", ["id"]).collect()} == {0: "malformed", 1: "malformed", 2: "unknown form", 3: "unknown form"}
    fields = {"t": "string", "v": "double"}
    for rows in (dict_rows(docs.where("id = 0"), "payload", fields), list_rows(docs.where("id = 1"), "payload", fields)):
        with pytest.raises(Exception, match="(?i)malformed"):
            rows.collect()
    for payload, read in (
        ('{"datetime":["a"],"Kp":[1', lambda d: parallel_rows(d, "payload", "datetime", "Kp")),
        ('{"datetime":["a"]}', lambda d: parallel_rows(d, "payload", "datetime", "Kp")),
        ('{"datetime":["a"],"Kp":[1,2]}', lambda d: parallel_rows(d, "payload", "datetime", "Kp")),
        ('{"international_sunspot_number":{}}', lambda d: nested_samples(d, "payload")),
        ('{"Observation Time":"o"}', lambda d: grid_rows(d, "payload")),
    ):
        with pytest.raises(Exception, match="(?i)malformed"):
            read(spark.createDataFrame([(payload,)], "payload string")).collect()


def test_later_document_beats_earlier_one(spark, tmp_path):
    put(tmp_path / "raw/dst/primary", "b.json", [{"time_tag": "2026-01-01T00:00:00", "dst": -1}, {"time_tag": "2026-01-01T01:00:00", "dst": -5}], age=100)
    put(tmp_path / "raw/dst/primary", "a.json", [{"time_tag": "2026-01-01T01:00:00", "dst": -50}], age=10)
    outcome = land_feeds(spark, str(tmp_path / "raw"), str(tmp_path / "tables"))
    assert outcome["dst"] == "landed"
    rows = {r.time_tag[11:13]: r.dst for r in spark.read.parquet(str(tmp_path / "tables/dst")).collect()}
    assert rows == {"00": -1.0, "01": -50.0}
    assert [r.document for r in read_documents(spark, str(tmp_path / "raw/dst/primary")).orderBy("document").collect()] == [0, 1]


def test_bad_feed_does_not_stop_the_others(spark, tmp_path):
    put(tmp_path / "raw/dst/primary", "a.json", [{"time_tag": "2026-01-01T00:00:00", "dst": "n/a"}])
    put(tmp_path / "raw/ssn/primary", "a.json", [{"Obsdate": "yesterday", "swpc_ssn": 3}])
    put(tmp_path / "raw/kp/primary", "a.json", [{"time_tag": "2026-01-01T00:00:00", "Kp": 2}])
    outcome = land_feeds(spark, str(tmp_path / "raw"), str(tmp_path / "tables"), stamp("2026-01-02"))
    assert (outcome["dst"], outcome["ssn"], outcome["kp"]) == ("failed", "failed", "landed")
    log = {r.feed: r for r in spark.read.parquet(str(tmp_path / "tables/fetch_log")).collect()}
    assert log["kp"].ok and not log["dst"].ok and log["dst"].reason and log["kp"]["at"].day == 2


def test_land_documents_rejects_unknown_forms(spark, tmp_path):
    docs = spark.createDataFrame([('[{"t":"a"}]',), ("{}",)], "payload string")
    with pytest.raises(ValueError, match="unknown form"):
        land_documents(spark, str(tmp_path / "x"), docs, "payload", {"t": "string"}, ["t"], "t", False)
    assert not (tmp_path / "x").exists()


def test_legacy_documents_reach_the_pipeline(spark, tmp_path):
    put(tmp_path / "old/old_mag", "a.json", [["time_tag", "bz_gsm", "bx_gsm", "by_gsm", "bt"], ["2025-01-01T00:00:00", "1", "2", "3", "4"]])
    put(tmp_path / "old/old_plasma", "a.json", [["time_tag", "speed", "density", "temperature"], ["2025-01-01T00:00:00", "1", "2", "3"]])
    land_legacy(spark, str(tmp_path / "old"), str(tmp_path / "tables"))
    tables = read_raw(spark, str(tmp_path / "tables"), recent_only=False)
    assert tables["old_mag"].first().bt == 4.0 and tables["old_plasma"].count() == 1
    assert read_raw(spark, str(tmp_path / "tables"), recent_only=True)["old_mag"].isEmpty()


def test_grid_documents_become_a_snapshot_feed(spark, tmp_path):
    put(tmp_path / "grid", "a.json", {"Observation Time": "o", "Forecast Time": "f", "coordinates": [[10, 70, 9]]})
    land_grid(spark, str(tmp_path / "grid"), str(tmp_path / "tables"))
    points, summary = views.nowcast(spark.read.parquet(str(tmp_path / "tables/grid")), product=["product"])
    assert points.count() == 1 and summary.first().max_value == 9


def test_null_and_missing_order(frame):
    df = frame("k STRING, v DOUBLE, seq INT", [("a", 1.0, None), ("a", 2.0, 1), ("b", 5.0, None)])
    assert {r.k: r.v for r in last_wins(df, ["k"], "seq").collect()} == {"a": 2.0, "b": 5.0}
    old = frame("k STRING, v DOUBLE", [("a", 0.0), ("b", 0.0)])
    assert {r.k: r.v for r in merge_records(old, df, ["k"], "seq").collect()} == {"a": 2.0, "b": 5.0}
    copies = frame("k STRING, v DOUBLE, w DOUBLE", [("a", 1.0, 9.0), ("a", 2.0, 1.0)])
    for parts in (1, 4):
        assert [tuple(r) for r in last_wins(copies.repartition(parts), ["k"]).collect()] == [("a", 2.0, 1.0)]


def test_bad_times_raise_or_are_counted(frame):
    df = frame("t STRING", [("2026-01",), ("2026-01-01T00:00:00Z",), ("soon",), (None,)])
    with pytest.raises(Exception, match="not a time: soon"):
        df.select(parse_time(F.col("t"))).collect()
    assert df.select(parse_time(F.col("t"), strict=False).alias("x")).where("x IS NULL").count() == 2
    assert bad_times(df, "t").first().bad_times == 1


def test_missing_active_flag_counts_as_inactive(frame):
    df = frame("time STRING, source STRING, active BOOLEAN, a DOUBLE", [("t", "ACE", None, 4.0), ("u", "ACE", None, 1.0), ("u", "DSCOVR", True, 2.0)])
    assert {r.time: r.a for r in select_source(df, ["time"], ["a"]).collect()} == {"t": 4.0, "u": 2.0}


@pytest.fixture
def stations(frame):
    """'late' ends 40 days before 'now'."""
    rows = [("now", f"2026-03-{d:02d}", float(d)) for d in range(1, 21)] + [("late", f"2026-02-{d:02d}", float(d)) for d in range(1, 9)]
    return frame("k STRING, time TIMESTAMP_NTZ, v DOUBLE", rows)


def days(df):
    return sorted((r.k, r.time.day) for r in df.collect())


def test_lagging_series_keep_their_own_window(spark, stations, tmp_path):
    want = [("late", 7), ("late", 8), ("now", 19), ("now", 20)]
    assert days(upsert_lookback(stations, "time", 24, ["k"])) == want
    assert days(retention_trim(stations, "time", "1 day", ["k"])) == want
    written = stations.withColumn("updated_at", stamp("2026-04-01"))
    assert days(change_feed(written, stamp("2026-03-31"), held_days=1, keys=["k"])) == want
    state, changed = delta_merge(stations.where("day(time) < 8"), stations.where("day(time) >= 8"), ["k", "time"], "time", 1)
    assert days(state) == want and days(changed) == [("late", 8), ("now", 19), ("now", 20)]
    path = str(tmp_path / "served")
    publish(spark, path, stations, ["k", "time"], ["v"], stamp("2026-04-01"), keep="1 day")
    assert days(spark.read.parquet(path)) == want
    publish(spark, path, stations, ["k", "time"], ["v"], stamp("2026-04-01"))
    assert days(slice_published(spark, path, "time", "1 day", ["k"])) == want
    pred = stations.withColumnRenamed("v", "dst_predictions")
    merged = views.dst_merged(pred, stations.withColumnRenamed("v", "dst").where("day(time) <> 20"), "24h", ["k"])
    assert sorted((r.k, r.time.day, r.dst) for r in merged.collect()) == [("late", 7, 7.0), ("late", 8, 8.0), ("now", 19, 19.0), ("now", 20, None)]


def test_global_right_side_serves_every_series(stations, frame):
    right = frame("time TIMESTAMP_NTZ, m DOUBLE", [("2026-02-03", 1.0), ("2026-03-10", 2.0)])
    got = sorted((r.k, r.time.day, r.m) for r in asof_join(stations, right, ["k"], "time", ["m"]).collect())
    want = sorted([("late", d, 1.0) for d in range(3, 9)] + [("now", d, 1.0 if d < 10 else 2.0) for d in range(1, 21)])
    assert got == want
    assert sorted((r.k, r.time.day, r.m) for r in asof_slow(stations, right, ["k"], "time", "m").collect()) == want


def test_slow_asof_equals_the_ordered_one(spark):
    rng = np.random.default_rng(4)
    minute = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(m AS INT))"
    left = spark.createDataFrame([(["a", "b"][int(rng.integers(2))], int(m)) for m in rng.integers(0, 20_000, 600)], "k string, m int")
    right = spark.createDataFrame([(["a", "b"][int(rng.integers(2))], int(m), float(i)) for i, m in enumerate(rng.choice(20_000, 40, False))], "k string, m int, v double")
    left, right = left.selectExpr("k", f"{minute} AS time"), right.selectExpr("k", f"{minute} AS time", "v")
    key = lambda df: sorted((r.k, r.time, r.v) for r in df.collect())
    assert key(asof_slow(left, right, ["k"], "time", "v")) == key(asof_join(left, right, ["k"], "time", ["v"]))


def test_slow_asof_with_a_fast_right_side(spark):
    """Buckets with many changes are answered by order: no array is longer than `most`."""
    minute = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST({} AS INT))"
    left = spark.range(0, 9000).selectExpr("CASE WHEN id % 3 > 0 THEN 'a' WHEN id % 2 > 0 THEN 'b' END AS k", f"{minute.format('id % 4500')} AS time", "id")
    fast = "SELECT 'a' AS k, id * 2 AS m, id * 1.0D AS v FROM range(720, 1400) UNION ALL SELECT 'a', 2000, 9.0D UNION ALL SELECT 'a', 2000, 7.0D UNION ALL SELECT 'a', 3000, NULL"
    right = spark.sql(f"{fast} UNION ALL SELECT 'b', 10, 1.0D UNION ALL SELECT 'b', 4000, 2.0D UNION ALL SELECT NULL, 1, 5.0D").selectExpr("k", f"{minute.format('m')} AS time", "v")
    steps = {k: sorted((r.time, r.v) for r in right.where("v IS NOT NULL").collect() if r.k == k) for k in "ab"}
    want = []
    for r in left.where("k IS NOT NULL").collect():
        past = steps[r.k][: bisect.bisect_right(steps[r.k], r.time, key=lambda s: s[0])]
        if past:
            want.append((r.id, r.k, r.time, past[-1][1]))
    for most in (0, 64):
        got = asof_slow(left, right, ["k"], "time", "v", most=most)
        assert sorted((r.id, r.k, r.time, r.v) for r in got.collect()) == sorted(want)
    one = right.where("k = 'a'").drop("k")
    every = asof_slow(left, one, ["k"], "time", "v")
    assert {r.k for r in every.collect()} == {"a", "b"} and every.where("k = 'a'").count() == sum(x[1] == "a" for x in want)
    longest = re.findall(r"_n#\d+L? <= (\d+)", asof_slow(left, right, ["k"], "time", "v")._jdf.queryExecution().optimizedPlan().toString())
    assert set(longest) == {"64"}


def test_views_read_only_the_months_they_need(spark, frame, tmp_path):
    rows = [(f"2025-{m:02d}-{d:02d}", float(m)) for m in range(1, 13) for d in (1, 15, 28)]
    for name, col in (("dst_predictions", "dst_predictions"), ("dst", "dst"), ("kp", "Kp")):
        publish(spark, str(tmp_path / name), frame(f"time TIMESTAMP_NTZ, {col} DOUBLE", rows), ["time"], [col], stamp("2026-01-01"))
    publish(spark, str(tmp_path / "solar"), frame("time TIMESTAMP_NTZ, bz DOUBLE", rows), ["time"], ["bz"], stamp("2026-01-01"))
    served = views.Served(spark, str(tmp_path))
    plans = {"kp": served.kp("1mo"), "merged": served.dst_merged("7d"), "solar": served.solar_raw("7d", ["bz"]), "latest": served.solar_latest(["bz"])}
    for name, df in plans.items():
        filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
        assert filters and all("month" in f for f in filters), name
    assert [r.time.day for r in plans["kp"].orderBy("time").collect()] == [28, 1, 15, 28]
    assert [(r.time.month, r.dst) for r in plans["merged"].collect()] == [(12, 12.0)]
    assert served.next_prediction().first().dst_predictions == 12.0 and served.dst_latest().first().dst == 12.0 and served.kp_latest().first().Kp == 12.0


def test_week_across_months_is_corrected(spark, frame, tmp_path):
    """The week from 30 March, corrected on 2 April."""
    dates = [f"2026-03-{d}" for d in (30, 31)] + [f"2026-04-0{d}" for d in range(1, 6)]
    rows = frame("time TIMESTAMP_NTZ, v DOUBLE", [(d, 3.0) for d in dates])
    base, weeks = str(tmp_path / "base"), str(tmp_path / "weeks")
    hook = refresh_buckets(spark, base, weeks, [], "time", ["v"], "week")
    publish(spark, base, rows, ["time"], ["v"], stamp("2026-04-06"))
    hook(rows.select("time"))
    fix = frame("time TIMESTAMP_NTZ, v DOUBLE", [("2026-04-02", 10.0)])
    publish(spark, base, fix, ["time"], ["v"], stamp("2026-04-07"))
    hook(fix.select("time"))
    assert [r.v for r in spark.read.parquet(weeks).collect()] == [4.0]
    with pytest.raises(ValueError, match="unknown bucket unit"):
        refresh_buckets(spark, base, weeks, [], "time", ["v"], "month")
    with pytest.raises(ValueError, match="empty buckets"):
        complete_bucket_stats(rows, [], "time", ["v"], "week", emit_empty=True)


def test_refresh_job_keeps_derived_tables_current(spark, tmp_path):
    minutes = spark.range(60 * 24 * 40).selectExpr("timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS time", "1.0D AS bz")
    cols = ["density", "speed", "temperature", "bx", "by", "bt", "pressure"]
    solar = minutes.withColumns({c: F.lit(2.0) for c in cols})
    serving, derived = str(tmp_path / "serving"), str(tmp_path / "derived")
    publish(spark, f"{serving}/solar", solar, ["time"], ["bz", *cols], stamp("2026-03-01"))
    refresh_served(spark, serving, derived)
    hourly = spark.read.parquet(f"{derived}/solar_hourly")
    assert hourly.count() == 24 * 31 and str(hourly.agg(F.min("time")).first()[0]) == "2026-01-09 23:00:00" or hourly.count() == 24 * 31 + 1
    fix = solar.where("time = timestamp_ntz'2026-02-05 10:30:00'").withColumn("bz", F.lit(61.0))
    publish(spark, f"{serving}/solar", fix, ["time"], ["bz", *cols], stamp("2026-03-02"))
    publish(spark, f"{serving}/dst", fix.select("time", F.lit(1.0).alias("dst")), ["time"], ["dst"], stamp("2026-03-02"))
    publish(spark, f"{serving}/dst_predictions", fix.select("time", F.lit(2.0).alias("dst_predictions")), ["time"], ["dst_predictions"], stamp("2026-03-02"))
    refresh_served(spark, serving, derived, stamp("2026-03-01"))
    means = {r.bz for r in spark.read.parquet(f"{derived}/solar_hourly").collect()}
    assert means == {1.0, 2.0}
    assert spark.read.parquet(f"{derived}/dst_merged").first().dst == 1.0


def test_narrow_column_has_no_large_window(spark):
    """200,000 distinct values in one coarse bin: the exact answer, and no bin of more than a few values."""
    from tidemark.operators.quantile import FINE_PER_UNIT, _bin

    rows = spark.range(200_000).selectExpr("101325 + id * 1e-4D AS v")
    assert quantiles(rows, [], ["v"], 0.97).first().v == pytest.approx(float(np.quantile(101325 + np.arange(200_000) * 1e-4, 0.97)), abs=1e-9)
    keyed = rows.withColumn("k", F.lit("hot"))
    assert quantiles(keyed, ["k"], ["v"], 0.5).first().v == pytest.approx(101325 + 99999.5e-4, abs=1e-9)
    coarse = rows.groupBy(F.expr(_bin("v")).alias("b")).count().agg(F.max("count")).first()[0]
    fine = rows.groupBy(F.expr(_bin("v", FINE_PER_UNIT)).alias("b")).count().agg(F.max("count")).first()[0]
    assert coarse > 100_000 and fine <= 5


def test_tail_needs_no_one_task_sort(spark, frame):
    rows = spark.range(30_000).selectExpr("id % 3 > 0 AS k", "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS time", "id")
    plan = tail_rows(rows, 4383, "time")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
    assert tail_rows(rows, 4383, "time").agg(F.min("id")).first()[0] == 30_000 - 4383
    keyed = tail_rows(rows, 5000, "time", ["k"], "1 day")
    windows = re.findall(r"windowspecdefinition\(([^)]*?)specifiedwindowframe", keyed._jdf.queryExecution().executedPlan().toString())
    assert all("_bucket#" in w for w in windows if "time#" in w)
    assert {r.k: r.n for r in keyed.groupBy("k").agg(F.count("*").alias("n")).collect()} == {True: 5000, False: 5000}
    assert keyed.where("k").agg(F.min("id")).first()[0] == rows.where("k").orderBy(F.desc("id")).limit(5000).agg(F.min("id")).first()[0]


def test_regular_grid_scores_without_counting(spark):
    rows = spark.range(2000).selectExpr("'a' AS k", "timestamp_ntz'2026-01-01' + make_dt_interval(0, CAST(id AS INT)) AS time", "id * 1.0D AS v")
    scorer = LinearScorer([[1.0]] * 24)
    key = lambda df: sorted((r.time, r.score) for r in df.collect())
    assert key(score_sequences(rows, ["k"], "time", ["v"], scorer, 24, 100, step="1 hour")) == key(score_sequences(rows, ["k"], "time", ["v"], scorer, 24, 100))


def test_workspace_removes_what_a_run_staged(spark, tmp_path):
    with workspace(spark):
        kept = shared_folder(spark, "x")
        spark.range(3).write.parquet(kept)
        assert os.path.isdir(kept.removeprefix("file:"))
    assert not os.path.exists(kept.removeprefix("file:"))
    with pytest.raises(RuntimeError), workspace(spark):
        gone = shared_folder(spark, "y")
        spark.range(3).write.parquet(gone)
        raise RuntimeError
    assert not os.path.exists(gone.removeprefix("file:"))
