import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.buckets import complete_bucket_mean
from tidemark.operators.merge import land_documents
from tidemark.operators.sequences import LinearScorer
from tidemark.plans.features import FEATURE_COLS
from tidemark.plans.indices import clean_feed, clean_index
from tidemark.plans.jobs import run
from tidemark.plans.solar import clean_solar
from tidemark.plans.transform import publish_all, transform
from tidemark.schemas import MAG_COLS, PLASMA_COLS, SERVING
from tidemark.streaming.incremental import cadence, refresh_buckets, refresh_join, stream_bucket_mean, stream_dedupe, upsert_stream, write_table

BASE = "2026-01-01"


def clock(minutes):
    return F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))


def feeds(spark, n, spike=None):
    """One active source per minute, speed 400 with an optional spike."""
    ids = spark.range(n)
    tag = F.date_format(clock(F.col("id")), "yyyy-MM-dd'T'HH:mm:ss").alias("time_tag")
    head = [tag, F.lit(True).alias("active"), F.lit("ACE").alias("source")]
    wave = F.sin(F.col("id") / 50.0)
    speed = F.when(F.col("id") == (-1 if spike is None else spike), 99999.0).otherwise(400.0)
    mag = ids.select(*head, (wave * 5).alias("bz_gsm"), wave.alias("bx_gsm"), (wave + 1).alias("by_gsm"), F.lit(5.0).alias("bt"))
    plasma = ids.select(*head, speed.alias("proton_speed"), F.lit(100000.0).alias("proton_temperature"), F.lit(5.0).alias("proton_density"))
    return mag, plasma


def test_spike_is_masked_and_interpolated(spark):
    out = clean_solar(*feeds(spark, 200, spike=100)).orderBy("time")
    assert out.columns == ["time", "speed", "temperature", "density", "bz", "bx", "by", "bt", "pressure"]
    rows = out.collect()
    assert len(rows) == 200 and {r.speed for r in rows} == {400.0}
    assert rows[0].pressure == round(1.6726e-27 * 5 * 1e6 * 400**2 * 1e6 * 1e9, 2)
    assert not any(v is None for r in rows for v in r)


def test_minutes_missing_in_both_feeds_are_filled(spark):
    mag, plasma = feeds(spark, 120)
    gone = F.minute(F.to_timestamp_ntz("time_tag")).between(20, 24)
    out = clean_solar(mag.where(~gone), plasma.where(~gone))
    assert out.count() == 120 and out.na.drop().count() == 120


def test_off_minute_records_and_invalid_values_vanish(spark):
    mag, plasma = feeds(spark, 60)
    late = plasma.limit(1).withColumn("time_tag", F.lit(f"{BASE}T00:30:02")).withColumn("proton_speed", F.lit(9.0))
    bad = F.when(F.col("time_tag").endswith("00:10:00"), -5.0).otherwise(F.col("proton_density"))
    out = clean_solar(mag, plasma.withColumn("proton_density", bad).unionByName(late))
    assert {r.speed for r in out.collect()} == {400.0} and {r.density for r in out.collect()} == {5.0}


def test_legacy_rows_win_and_extend_the_series(spark, frame):
    mag, plasma = feeds(spark, 30)
    old_mag = frame(
        "time_tag STRING, bz_gsm DOUBLE, bx_gsm DOUBLE, by_gsm DOUBLE, bt DOUBLE, extra INT",
        [("2025-12-31T23:58:00", 1.0, 1.0, 1.0, 1.0, 0)] * 2 + [(f"{BASE}T00:00:00", 1.0, 1.0, 1.0, 2.0, 0)],
    )
    old_plasma = frame(
        "time_tag STRING, speed DOUBLE, density DOUBLE, temperature DOUBLE", [("2025-12-31T23:58:00", 400.0, 5.0, 100000.0)]
    )
    out = clean_solar(mag, plasma, old_mag, old_plasma, q=1.0).orderBy("time").collect()
    assert len(out) == 32 and [r.bt for r in out[:4]] == [1.0, 1.5, 2.0, 5.0]


def test_keyed_series_are_independent(spark):
    mag, plasma = feeds(spark, 90, spike=40)
    stations = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "station string, f double")
    wide = plasma.join(stations).withColumn("proton_temperature", F.col("proton_temperature") * F.col("f")).drop("f")
    out = clean_solar(mag.join(stations.drop("f")), wide, keys=["station"])
    assert {(r.station, r.temperature): r["count"] for r in out.groupBy("station", "temperature").count().collect()} == {
        ("a", 100000.0): 90, ("b", 200000.0): 90,
    }


def test_index_feeds(frame):
    kp = frame("time_tag STRING, Kp DOUBLE", [("2026-01-01T00:00:00", None), ("2026-01-01T03:00:00", 2.0), ("2026-01-01T06:00:00", None), ("2026-01-02T06:00:00", 4.0)])
    out = clean_feed("kp", kp).orderBy("time")
    assert out.columns == ["time", "Kp"] and [r.Kp for r in out.collect()] == [2.0, 2.0, 3.0, 4.0]
    ssn = frame("Obsdate STRING, swpc_ssn DOUBLE", [(f"2026-01-0{d}", float(d)) for d in range(1, 8)])
    assert [r.swpc_ssn for r in clean_index(ssn, "Obsdate", ["swpc_ssn"], tail=3).orderBy("time").collect()] == [5.0, 6.0, 7.0]
    assert clean_feed("smoothed_ssn", frame("`time-tag` STRING, predicted_ssn DOUBLE", [("2026-01", 9.0)])).first().time.month == 1


def test_whole_transform_and_publication(spark, frame, tmp_path):
    n = 30 * 60
    mag, plasma = feeds(spark, n)
    hourly = [(f"{BASE}T{h:02d}:00:00", float(-h)) for h in range(24)]
    landed = {
        "mag": mag,
        "plasma": plasma,
        "dst": frame("time_tag STRING, dst DOUBLE", hourly),
        "kp": frame("time_tag STRING, Kp DOUBLE", hourly[::3]),
        "ssn": frame("Obsdate STRING, swpc_ssn DOUBLE", [("2026-01-01", 5.0), ("2026-01-02", 6.0)]),
        "smoothed_ssn": frame("`time-tag` STRING, predicted_ssn DOUBLE", [("2025-12", 57.9), ("2026-02", 60.0)]),
    }
    out = transform(landed, LinearScorer(np.zeros((24, len(FEATURE_COLS))), 0.5), length=24)
    assert len(FEATURE_COLS) == 15 and set(out) == set(SERVING)
    for name, df in out.items():
        assert set(df.columns) == {"time", *SERVING[name]}
        assert df.count() > 0 and df.na.drop().count() == df.count()
    predicted = out["dst_predictions"].orderBy("time").collect()
    assert len(predicted) == 7 and str(predicted[0].time) == "2026-01-02 00:00:00" and predicted[0].dst_predictions == 1.5

    def stamp(text):
        return F.lit(text).cast("timestamp_ntz")

    publish_all(spark, str(tmp_path), out, stamp("2026-01-03"), upsert_hours=10000)
    publish_all(spark, str(tmp_path), out, stamp("2026-01-04"))
    solar = spark.read.parquet(f"{tmp_path}/solar")
    assert solar.count() == n and solar.where("updated_at > timestamp_ntz'2026-01-03'").isEmpty()
    assert spark.read.parquet(f"{tmp_path}/metadata").first().last_synced.day == 4


def test_batch_run_from_documents(spark, tmp_path):
    """Documents to serving tables: primary forms, every fallback form, a failed feed, a second run."""
    landing, raw, serving = (str(tmp_path / n) for n in ("landing", "raw", "serving"))

    def put(feed, kind, payload, name="1.json"):
        folder = tmp_path / "landing" / feed / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(payload if isinstance(payload, str) else json.dumps(payload))

    mag, plasma = feeds(spark, 28 * 60)
    for feed, df, cols in (("mag", mag, MAG_COLS), ("plasma", plasma, PLASMA_COLS)):
        records = [r.asDict() for r in df.collect()]
        put(feed, "primary", records[:900])
        put(feed, "primary", [list(records[0]), *[list(r.values()) for r in records[900:]]], "2.json")
        assert set(cols) < set(records[0])
    put("dst", "primary", "")  # an empty answer: the fixed-width fallback serves
    fields = "".join(str(-h).rjust(4) for h in range(24))
    put("dst", "fallback", f"<html>\nDST2601*01RRX020   {'   0'}{fields}   1\n", "dst.txt")
    put("kp", "primary", [{"time_tag": "2026-01-01T00:00:00", "wrong": 1}])
    put("kp", "fallback", {"datetime": ["2026-01-01T00:00:00Z", "2026-01-01T03:00:00Z"], "Kp": [2.0, 4.0]})
    put("ssn", "fallback", {"international_sunspot_number": {"samples": [{"time": "2026 01 01", "ssn": 7.0}]}})
    put("smoothed_ssn", "fallback", [{"time_tag": "2025-12", "smoothed_ssn": 57.9}])
    scorer = LinearScorer(np.zeros((24, 15)), 0.0)

    def go(day):
        now = F.lit(f"2026-01-{day:02d}").cast("timestamp_ntz")
        return run(spark, landing, raw, serving, scorer, now=now, length=24)

    assert set(go(3).values()) == {"landed"}
    assert {r.dst_predictions for r in spark.read.parquet(f"{serving}/dst_predictions").collect()} == {-8.0}
    assert sorted(r.Kp for r in spark.read.parquet(f"{serving}/kp").collect()) == [2.0, 4.0]
    assert spark.read.parquet(f"{serving}/dst").count() == 24 and spark.read.parquet(f"{serving}/ssn").first().swpc_ssn == 7.0
    shutil.rmtree(tmp_path / "landing" / "kp")
    outcome = go(4)
    assert outcome.pop("kp") == "failed" and set(outcome.values()) == {"landed"}
    for name in SERVING:  # nothing changed, the failed feed is served from what landed before
        table = spark.read.parquet(f"{serving}/{name}")
        assert table.count() > 0 and table.where("updated_at > timestamp_ntz'2026-01-03'").isEmpty()


def test_documents_land_by_form(spark, tmp_path):
    lists = json.dumps([["t", "v"], ["2026-01", 1], ["2026-02", 2]])
    newer = json.dumps([["v", "t"], [9, "2026-02"]])
    dicts = json.dumps([{"t": "2026-01-05", "v": 1}, {"t": "2026-01-05", "v": 2}])
    fields = {"t": "string", "v": "double"}
    for doc in (lists, newer, dicts):
        land_documents(spark, str(tmp_path), spark.createDataFrame([(doc,)], "p string"), "p", fields, ["t"], "t", True)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/lists").collect()) == [("2026-01", 1.0), ("2026-02", 9.0)]
    assert [r.v for r in spark.read.parquet(f"{tmp_path}/dicts").collect()] == [2.0]


def test_small_join_is_rebuilt_whole(spark, frame, tmp_path):
    pred, obs, out = (f"{tmp_path}/{n}" for n in ("pred", "obs", "out"))
    hook = refresh_join(spark, pred, obs, out)
    frame("time TIMESTAMP_NTZ, dst_predictions DOUBLE", [("2026-01-01", 1.0), ("2026-01-02", 2.0)]).write.parquet(pred)
    hook(None)
    for value in (5.0, 6.0):
        frame("time TIMESTAMP_NTZ, dst DOUBLE", [("2026-01-01", value)]).write.mode("overwrite").parquet(obs)
        hook(None)
        rows = spark.read.parquet(out).orderBy("time").collect()
        assert [(r.dst_predictions, r.dst) for r in rows] == [(1.0, value), (2.0, None)]


def write_minutes(spark, folder, part, lo, hi, value):
    rows = spark.range(lo, hi).select(F.lit("a").alias("k"), clock(F.col("id")).alias("time"), (F.col("id") % 60 * value).alias("v"), F.col("id").alias("seq"))
    rows.coalesce(1).write.parquet(f"{folder}/{part}")


SCHEMA = "k string, time timestamp_ntz, v double, seq bigint"


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_stream_of_complete_hours_equals_batch(spark, tmp_path):
    folder = f"{tmp_path}/in"
    write_minutes(spark, folder, "1", 0, 150, 1.0)
    write_minutes(spark, folder, "2", 150, 419, 1.0)
    stream = stream_bucket_mean(source(spark, folder), ["k"], "time", ["v"], "hour", "30 minutes")
    write_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    batch = complete_bucket_mean(spark.read.schema(SCHEMA).parquet(f"{folder}/*"), ["k"], "time", ["v"])
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) == 6


def test_stream_dedupe_across_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    write_minutes(spark, folder, "1", 0, 50, 1.0)
    write_minutes(spark, folder, "2", 20, 70, 1.0)
    stream = stream_dedupe(source(spark, folder), ["k", "time"], "time")
    write_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 70


def test_upsert_stream_with_late_corrections(spark, tmp_path):
    folder, table, hourly = f"{tmp_path}/in", f"{tmp_path}/table", f"{tmp_path}/hourly"
    hook = refresh_buckets(spark, table, hourly, ["k"], "time", ["v"])

    def run(day):
        upsert_stream(
            spark, source(spark, folder), table, f"{tmp_path}/cp", ["k", "time"], ["v"], seq="seq",
            now=F.lit(f"2026-02-{day:02d}").cast("timestamp_ntz"), after=hook,
        ).awaitTermination()

    def expected():
        rows = spark.read.parquet(table)
        return sorted(tuple(r) for r in complete_bucket_mean(rows, ["k"], "time", ["v"]).collect())

    def held():
        return sorted(tuple(r) for r in spark.read.parquet(hourly).select("k", "time", "v").collect())

    write_minutes(spark, folder, "1", 0, 130, 1.0)
    run(1)
    assert spark.read.parquet(table).count() == 130 and held() == expected() and len(held()) == 2
    write_minutes(spark, folder, "2", 100, 180, 2.0)  # corrects two hours, completes the third
    run(2)
    assert held() == expected() and len(held()) == 3
    stamps = spark.read.parquet(table).groupBy("updated_at").count().orderBy("updated_at").collect()
    # minute 120 holds 0 before and after, so it did not change
    assert [(r.updated_at.day, r["count"]) for r in stamps] == [(1, 101), (2, 79)]
    run(3)  # nothing new
    assert spark.read.parquet(table).where("updated_at > timestamp_ntz'2026-02-02'").isEmpty()


def test_cadence():
    assert cadence("solar") == {"processingTime": "30 seconds"} and cadence("ssn") == {"processingTime": "300 seconds"}


def test_shared_folder_needs_a_shared_root(spark):
    from tidemark import session

    class Remote:
        class sparkContext:  # noqa: N801
            master = "spark://host"

        class conf:  # noqa: N801
            @staticmethod
            def get(_, default):
                return default

    saved = dict(session._LOCAL_ROOT)
    session._LOCAL_ROOT.clear()
    try:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Remote, "x")
    finally:
        session._LOCAL_ROOT.update(saved)
