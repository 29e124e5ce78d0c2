"""Buckets kept in the state of a stream, pruning by series, stored cursors, views before the first publication."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cursor
from tidemark.operators.buckets import complete_bucket_mean, prune_buckets
from tidemark.operators.cursor import last_poll, next_poll, run_poll
from tidemark.operators.publish import latest_published, publish, slice_published
from tidemark.plans import jobs
from tidemark.plans.jobs import refresh_served
from tidemark.plans.views import Served
from tidemark.streaming.bucket_state import PROVIDER, bucket_changes, write_buckets
from tidemark.streaming.incremental import prune_published

SCHEMA = "k string, time timestamp_ntz, v double, w double, seq bigint, gone boolean"


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def deliver(spark, root, rows, keys=("k",), **options):
    texty = SCHEMA.replace("timestamp_ntz", "string")
    df = spark.createDataFrame(rows, texty).withColumn("time", F.col("time").cast("timestamp_ntz"))
    df.repartition(3).write.mode("append").parquet(f"{root}/in")
    changes = bucket_changes(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), list(keys), "time", ["v", "w"], "hour", "seq", "gone", **options)
    write_buckets(spark, changes, f"{root}/hours", f"{root}/checkpoint", list(keys), ["v", "w"]).awaitTermination()
    table = spark.read.schema("k string, time timestamp_ntz, v double, w double").parquet(f"{root}/hours")
    return sorted((r.k, str(r.time), r.v, r.w) for r in table.collect()) if keys else sorted((str(r.time), r.v, r.w) for r in table.collect())


def at(minute):
    return f"2026-01-{31 + minute // 1440 if minute < 0 else 1 + minute // 1440:02d} {minute % 1440 // 60:02d}:{minute % 60:02d}:00"


def test_state_equals_recomputed_hours(spark, tmp_path):
    """Rows in any order over several deliveries, values replaced, missing and taken out again."""
    before = spark.conf.get(PROVIDER, None)
    rng = random.Random(3)
    held, seq = {}, 0
    for delivery in range(3):
        rows = []
        for k in ("a", "a b'c"):
            for minute in range(240):
                if rng.random() < (0.97, 0.6, 0.05)[delivery]:
                    seq += 1
                    gone = delivery > 0 and rng.random() < 0.004
                    value = (round(rng.uniform(-5, 5), 2), None if rng.random() < 0.1 else 1.0 * minute)
                    rows.append((k, at(minute), *value, seq, gone))
                    if rng.random() < 0.1:  # an older copy of the same time in the same delivery
                        rows.append((k, at(minute), 99.0, 99.0, seq - 1_000_000, False))
                    held[k, minute] = None if gone else value
        rng.shuffle(rows)
        got = deliver(spark, tmp_path, rows)
        base = [(k, at(m), *v) for (k, m), v in held.items() if v]
        base = spark.createDataFrame(base, "k string, time string, v double, w double").withColumn("time", F.col("time").cast("timestamp_ntz"))
        assert got == sorted((r.k, str(r.time), r.v, r.w) for r in complete_bucket_mean(base, ["k"], "time", ["v", "w"]).collect())
    assert got and spark.conf.get(PROVIDER, None) == before


def test_lagging_series_keeps_its_own_window(spark, tmp_path):
    hour = lambda k, day, h: [(k, f"2026-01-{day:02d} {h:02d}:{m:02d}:00", 1.0, 2.0, 0, False) for m in range(60)]
    assert [x[:2] for x in deliver(spark, tmp_path, hour("old", 2, 5) + hour("new", 2, 5), held_days=3)] == [("new", "2026-01-02 05:00:00"), ("old", "2026-01-02 05:00:00")]
    got = deliver(spark, tmp_path, hour("new", 9, 1) + hour("old", 3, 0), held_days=3)
    assert [x[:2] for x in got] == [("new", "2026-01-09 01:00:00"), ("old", "2026-01-02 05:00:00"), ("old", "2026-01-03 00:00:00")]
    got = deliver(spark, tmp_path, hour("new", 2, 5)[:30], held_days=3)  # too late: it does not come back
    assert [x[0] for x in got] == ["new", "old", "old"]


def test_state_without_keys_and_bad_units(spark, tmp_path):
    rows = [("x", at(m), 1.0, None, m, False) for m in range(60)] + [("x", None, 1.0, 1.0, 0, False)]
    assert deliver(spark, tmp_path, rows, keys=()) == [("2026-01-01 00:00:00", 1.0, None)]
    with pytest.raises(ValueError, match="units"):
        bucket_changes(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), ["k"], "time", ["v"], "week")


def test_pruning_by_series(spark, frame, tmp_path):
    days = [f"2026-{m:02d}-{d:02d}" for m in (1, 2, 3) for d in (1, 10, 20)]
    rows = frame("k STRING, time TIMESTAMP_NTZ, v DOUBLE", [("new", d, 1.0) for d in days] + [("old", d, 2.0) for d in days[:3]])
    base, published = str(tmp_path / "base"), str(tmp_path / "published")
    for path in (base, published):
        publish(spark, path, rows, ["k", "time"], ["v"], stamp("2026-04-01"))
    prune_published(spark, base, published, "time", "day", 31, ["k"])
    left = sorted((r.k, str(r.time)[:10]) for r in spark.read.parquet(published).collect())
    assert left == [("new", d) for d in days[5:]] + [("old", d) for d in days[:3]]
    pruned = prune_buckets(rows, rows.where("(k = 'old' AND time >= '2026-01-10') OR (k = 'new' AND time >= '2026-03-10')"), "time", "day", ["k"])
    assert sorted((r.k, str(r.time)[:10]) for r in pruned.collect()) == [("new", d) for d in days[7:]] + [("old", d) for d in days[1:3]]


def test_a_failed_poll_is_repeated_over_the_same_range(spark, frame, tmp_path):
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    put = lambda rows, now: publish(spark, path, frame("time TIMESTAMP_NTZ, v DOUBLE", rows), ["time"], ["v"], stamp(now))
    seen = {}

    def apply(rows, poll, fail=False):
        seen[poll.number] = sorted((r.time.day, r.v) for r in rows.collect())
        if fail:
            raise RuntimeError

    poll = lambda fail=False, **o: run_poll(spark, path, log, "r", lambda rows, p: apply(rows, p, fail), **o)
    assert poll() is None  # no table yet
    put([("2026-01-01", 1.0), ("2026-01-02", 1.0)], "2026-02-01")
    with pytest.raises(RuntimeError):
        poll(True)
    put([("2026-01-02", 2.0), ("2026-01-03", 2.0)], "2026-02-02")
    assert poll().number == 0 and seen == {0: [(1, 1.0)]}  # what changed since waits for the next poll
    assert poll().number == 1 and seen[1] == [(2, 2.0), (3, 2.0)]
    assert poll() is None and last_poll(spark, log, "r")[1]
    put([("2026-01-03", 3.0)], "2026-02-03")
    assert poll(lag="1 hour", as_of=stamp("2026-02-03 00:30:00")) is None
    assert poll(lag="1 hour", as_of=stamp("2026-02-03 01:30:00")).number == 2 and seen[2] == [(3, 3.0)]
    assert next_poll(spark, log, "another", spark.read.parquet(path)).number == 0


def test_poll_log_stays_short(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(cursor, "_FILES", 4)
    path, log = str(tmp_path / "t"), str(tmp_path / "log")
    for day in range(1, 5):
        publish(spark, path, frame("time TIMESTAMP_NTZ, v DOUBLE", [("2026-01-01", 1.0 * day)]), ["time"], ["v"], stamp(f"2026-02-0{day}"))
        run_poll(spark, path, log, "r", lambda rows, p: None)
        run_poll(spark, path, log, "s", lambda rows, p: None)
    assert last_poll(spark, log, "r")[0].number == 3 and last_poll(spark, log, "s")[1]
    assert len(spark.read.parquet(log).inputFiles()) <= 4


def test_poller_remembers_and_repeats(spark, tmp_path, monkeypatch):
    minutes = spark.range(60 * 24 * 2).selectExpr("timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS time", "1.0D AS bz")
    cols = ["density", "speed", "temperature", "bx", "by", "bt", "pressure"]
    solar = minutes.withColumns({c: F.lit(2.0) for c in cols})
    serving, derived = str(tmp_path / "serving"), str(tmp_path / "derived")
    refresh_served(spark, serving, derived)  # nothing published yet
    publish(spark, f"{serving}/solar", solar, ["time"], ["bz", *cols], stamp("2026-03-01"))
    refresh_served(spark, serving, derived)
    assert spark.read.parquet(f"{derived}/solar_hourly").count() == 48
    fix = solar.where("time = timestamp_ntz'2026-01-02 10:30:00'").withColumn("bz", F.lit(61.0))
    publish(spark, f"{serving}/solar", fix, ["time"], ["bz", *cols], stamp("2026-03-02"))
    touched = []
    real = jobs.refresh_buckets

    def counted(*args, fail=False, **options):
        hook = real(*args, **options)

        def run(rows):
            touched.append(rows.count())
            hook(rows)
            if fail:
                raise RuntimeError

        return run

    monkeypatch.setattr(jobs, "refresh_buckets", lambda *a, **o: counted(*a, fail=True, **o))
    with pytest.raises(RuntimeError):
        refresh_served(spark, serving, derived)
    monkeypatch.setattr(jobs, "refresh_buckets", counted)
    refresh_served(spark, serving, derived)
    refresh_served(spark, serving, derived)
    assert touched == [1, 1]  # the failed pass, its repetition, and nothing more
    assert {r.bz for r in spark.read.parquet(f"{derived}/solar_hourly").collect()} == {1.0, 2.0}


def test_views_before_the_first_publication(spark, tmp_path):
    served = Served(spark, str(tmp_path / "none"))
    for view in (served.solar_raw("7d"), served.solar_monthly(["bz"]), served.solar_latest(["speed"]), served.dst_merged(), served.kp(), served.dst_latest(), served.kp_latest(), served.next_prediction()):
        assert view.count() == 0
    assert served.solar_latest(["speed"]).columns[-1] == "speed"
    assert slice_published(spark, str(tmp_path / "x"), "time", "1 day").count() == 0 and latest_published(spark, str(tmp_path / "x"), "time").count() == 0
