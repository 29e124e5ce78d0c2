"""Landing that reads a document once, keeps every row through failures, and counts while it writes."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import land_single
from tidemark.operators.publish import feed_silence
from tidemark.plans.jobs import land_feeds, land_grid
from tidemark.session import workspace
from tidemark.sources import landing as module
from tidemark.sources.ledger import pending, record
from tidemark.sources.payloads import read_dicts
from tidemark.sources.tables import replace_table, restore_table


def put(folder, name, payload, age=0):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
    os.utime(path, (time.time() - age, time.time() - age))


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def kp(day, value):
    return {"time_tag": f"2026-01-{day:02d}T00:00:00", "Kp": value}


def landed(spark, raw, feed="kp", col="Kp"):
    return {r[0][8:10]: r[1] for r in spark.read.parquet(f"{raw}/{feed}").select("time_tag", col).collect()}


def test_second_run_reads_no_document(spark, tmp_path, monkeypatch):
    folder, raw = tmp_path / "in", str(tmp_path / "raw")
    put(folder / "kp/primary", "a.json", [kp(1, 1), kp(2, 2)], age=300)
    read = []
    monkeypatch.setattr(module, "read_pending", lambda s, files, real=module.read_pending: (read.append([f.path.rsplit("/", 1)[-1] for f in files]), real(s, files))[1])
    assert land_feeds(spark, str(folder), raw, stamp("2026-02-01"))["kp"] == "landed"
    assert land_feeds(spark, str(folder), raw, stamp("2026-02-02"))["kp"] == "landed"
    assert read == [["a.json"]]
    put(folder / "kp/primary", "b {1}, [x].json", [kp(2, 5), kp(3, 3)], age=200)
    land_feeds(spark, str(folder), raw, stamp("2026-02-03"))
    put(folder / "kp/primary", "a.json", [kp(1, 9)], age=100)  # written again
    land_feeds(spark, str(folder), raw, stamp("2026-02-04"))
    assert read == [["a.json"], ["b {1}, [x].json"], ["a.json"]]
    assert landed(spark, raw) == {"01": 9.0, "02": 5.0, "03": 3.0}
    log = [(r["at"].day, r.ok, r.documents, r.records, r.latest.day) for r in spark.read.parquet(f"{raw}/fetch_log").where("feed = 'kp'").orderBy("at").collect()]
    assert log == [(1, True, 1, 2, 2), (3, True, 1, 2, 3), (4, True, 1, 1, 1)]


def test_deliveries_in_any_order_give_the_newest_records(spark, tmp_path):
    """A delivery that was held up does not undo a newer one: the same rows as all documents at once."""
    documents = {"1": ([kp(1, 1), kp(2, 1), kp(3, 1)], 900), "2": ([kp(2, 2), kp(3, 2)], 600), "3": ([kp(3, 3), kp(4, 3)], 300)}
    results = []
    for order in (["123"], ["1", "2", "3"], ["3", "1", "2"], ["2", "31"]):
        base = tmp_path / "-".join(order)
        for names in order:
            for name in names:
                put(base / "in/kp/primary", f"{name}.json", *documents[name])
            land_feeds(spark, str(base / "in"), str(base / "raw"))
        results.append(landed(spark, base / "raw"))
    assert results == [{"01": 1.0, "02": 2.0, "03": 3.0, "04": 3.0}] * 4


def test_bad_documents_are_refused_one_by_one(spark, tmp_path):
    folder, raw = tmp_path / "in", str(tmp_path / "raw")
    put(folder / "dst/primary", "a.json", [{"time_tag": "2026-01-01T00:00:00", "dst": -1}], age=500)
    put(folder / "dst/primary", "b.json", [{"time_tag": "2026-01-02T00:00:00", "dst": "n/a"}], age=400)
    put(folder / "dst/primary", "c.json", [{"time_tag": "someday", "dst": 1}], age=300)
    put(folder / "dst/primary", "d.json", '[{"time_tag": "2026-01-04T00:00', age=200)
    put(folder / "dst/primary", "e.json", '{"x": 1}', age=100)
    put(folder / "dst/primary", "f.json", [["dst", "time_tag"], ["-6", "2026-01-06T00:00:00"]], age=50)
    assert land_feeds(spark, str(folder), raw)["dst"] == "landed"
    assert landed(spark, raw, "dst", "dst") == {"01": -1.0, "06": -6.0}
    log = spark.read.parquet(f"{raw}/fetch_log").where("feed = 'dst'").first()
    assert (log.ok, log.documents, log.refused, log.records) == (True, 6, 4, 2)
    states = {os.path.basename(r.path): (r.state, r.reason) for r in spark.read.parquet(f"{raw}/ledger").collect()}
    assert states == {
        "a.json": ("landed", None), "b.json": ("refused", "no double: dst"), "c.json": ("refused", "no time: time_tag"),
        "d.json": ("refused", "malformed"), "e.json": ("refused", "unknown form"), "f.json": ("landed", None),
    }
    put(folder / "dst/primary", "b.json", [{"time_tag": "2026-01-02T00:00:00", "dst": -2}], age=10)
    land_feeds(spark, str(folder), raw)
    assert landed(spark, raw, "dst", "dst") == {"01": -1.0, "02": -2.0, "06": -6.0}


def test_fallback_lands_only_for_want_of_a_primary(spark, tmp_path):
    folder, raw = tmp_path / "in", str(tmp_path / "raw")
    arrays = lambda v: {"datetime": ["2026-01-01T00:00:00Z"], "Kp": [v]}
    put(folder / "kp/primary", "a.json", [kp(1, 1)], age=900)
    put(folder / "kp/fallback", "a.json", arrays(7), age=800)  # passed over, also later
    land_feeds(spark, str(folder), raw)
    land_feeds(spark, str(folder), raw)
    assert landed(spark, raw) == {"01": 1.0}
    put(folder / "kp/fallback", "b.json", arrays(8), age=700)  # nothing new from the primary
    land_feeds(spark, str(folder), raw)
    assert landed(spark, raw) == {"01": 8.0}
    put(folder / "kp/primary", "b.json", "no json", age=600)
    put(folder / "kp/fallback", "c.json", '{"datetime": ["2026-01-01T00:00:00Z"]}', age=500)
    assert land_feeds(spark, str(folder), raw, stamp("2026-02-01"))["kp"] == "failed"
    log = spark.read.parquet(f"{raw}/fetch_log").where("feed = 'kp' AND NOT ok").first()
    assert "unknown form" in log.reason and "malformed payload: no Kp" in log.reason and log.documents == 2
    silence = feed_silence(spark.read.parquet(f"{raw}/fetch_log"), "feed", "at", "ok", stamp("2036-01-01")).where("feed = 'kp'").first()
    assert silence.silent


def test_other_errors_are_raised_and_nothing_is_recorded(spark, tmp_path, monkeypatch):
    folder, raw = tmp_path / "in", str(tmp_path / "raw")
    put(folder / "kp/primary", "a.json", [kp(1, 1)])
    real = module.read_pending
    monkeypatch.setattr(module, "read_pending", lambda s, files: real(s, files).withColumn("document", F.assert_true(F.lit(False), "disk full").cast("bigint") + 1 / F.lit(0)))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|disk full"):
        land_feeds(spark, str(folder), raw)
    assert not os.path.exists(f"{raw}/ledger")
    monkeypatch.setattr(module, "read_pending", real)
    assert land_feeds(spark, str(folder), raw)["kp"] == "landed"


def test_a_run_that_stops_before_the_ledger_changes_nothing_twice(spark, tmp_path, monkeypatch):
    from tidemark.plans import jobs

    folder, raw = tmp_path / "in", str(tmp_path / "raw")
    put(folder / "kp/primary", "a.json", [kp(1, 1), kp(2, 2)], age=100)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(jobs, "record", stop)
        with pytest.raises(RuntimeError):
            land_feeds(spark, str(folder), raw)
    land_feeds(spark, str(folder), raw)
    assert landed(spark, raw) == {"01": 1.0, "02": 2.0}


def test_failed_write_keeps_every_row(spark, frame, tmp_path):
    path = str(tmp_path / "table")
    land_single(spark, path, frame("t STRING, v DOUBLE", [("a", 1.0), ("b", 2.0)]), ["t"])
    broken = frame("t STRING, v DOUBLE", [("b", 3.0), ("c", 4.0)]).withColumn("v", F.when(F.col("t") == "c", F.raise_error(F.lit("full")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="full"), workspace(spark):
        land_single(spark, path, broken, ["t"])
    assert {r.t: r.v for r in spark.read.parquet(path).collect()} == {"a": 1.0, "b": 2.0}
    land_single(spark, path, frame("t STRING, v DOUBLE", [("b", 3.0)]), ["t"])
    assert {r.t: r.v for r in spark.read.parquet(path).collect()} == {"a": 1.0, "b": 3.0}
    assert sorted(os.listdir(tmp_path)) == ["table"]


def test_replacement_cut_short_is_ended(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark, frame("v INT", [(1,)]), path)
    os.rename(path, f"{path}._old")  # the run stopped between the renames
    restore_table(spark, path)
    assert spark.read.parquet(path).first().v == 1
    replace_table(spark, spark.read.parquet(path).selectExpr("v + 1 AS v"), path)
    assert spark.read.parquet(path).first().v == 2


def test_grid_lands_once(spark, tmp_path):
    grid = {"Observation Time": "o", "Forecast Time": "f", "coordinates": [[10, 70, 9], [11, 70, 8]]}
    put(tmp_path / "grid", "a.json", grid, age=100)
    raw = str(tmp_path / "raw")
    assert land_grid(spark, str(tmp_path / "grid"), raw) == 1 and land_grid(spark, str(tmp_path / "grid"), raw) == 0
    put(tmp_path / "grid", "b.json", grid, age=50)
    assert land_grid(spark, str(tmp_path / "grid"), raw) == 1
    assert spark.read.parquet(f"{raw}/grid").count() == 4


def test_damaged_file_raises(spark, tmp_path):
    put(tmp_path, "a.json", '[{"t": "x", "v": 1}, {"t"')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_dicts(spark, str(tmp_path), "t string, v double").collect()


def test_ledger_of_many_files_becomes_one(spark, tmp_path, monkeypatch):
    from tidemark.sources import ledger

    monkeypatch.setattr(ledger, "_FILES", 3)
    put(tmp_path / "in", "a.json", "x")
    files, table = pending(spark, str(tmp_path / "in"), str(tmp_path / "ledger")), str(tmp_path / "ledger")
    for i in range(5):
        record(spark, table, f"f{i}", [(files[0], "landed", None)], stamp("2026-01-01"))
    rows = spark.read.parquet(table)
    assert rows.count() == 5 and len(rows.inputFiles()) <= 3 and not pending(spark, str(tmp_path / "in"), table)
