import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.schemas import REQUIRED
from tidemark.sources.contracts import ContractError, check_contract, choose_feed, first_valid, schema_drift
from tidemark.sources.fixed_width import hourly_records
from tidemark.sources.payloads import (
    after_marker,
    dict_rows,
    grid_rows,
    list_rows,
    nested_samples,
    parallel_rows,
    payload_rows,
    read_dicts,
    read_documents,
    rename_mirror,
    sniff,
)
from tidemark.sources.tables import lookback_scan

FIELDS = {"time_tag": "string", "dst": "double"}


def docs(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "payload string")


def rows(df):
    return sorted((r.time_tag, r.dst) for r in df.collect())


def test_dicts_ignore_extra_keys_and_miss_to_null(spark):
    df = docs(spark, [{"time_tag": "t1", "dst": -3, "extra": 1}, {"time_tag": "t2"}])
    assert rows(dict_rows(df, "payload", FIELDS)) == [("t1", -3.0), ("t2", None)]


def test_lists_follow_their_own_header(spark):
    df = docs(spark, [["dst", "time_tag", "x"], [-5, "t1", 1], ["-6.5", "t2", None], [None, "t3"]], [["time_tag"], ["t4"]], [["time_tag", "dst"]])
    assert rows(list_rows(df, "payload", FIELDS)) == [("t1", -5.0), ("t2", -6.5), ("t3", None), ("t4", None)]


def test_format_routing(spark):
    a, b = [["time_tag", "dst"], ["t1", 1]], [{"time_tag": "t2", "dst": 2}]
    assert rows(payload_rows(docs(spark, a, b), "payload", FIELDS)) == [("t1", 1.0), ("t2", 2.0)]
    forms = docs(spark, a, b, [], {"k": 1}, " [ [1]]").select(sniff(F.col("payload"))).collect()
    assert [f[0] for f in forms] == ["list_of_lists", "list_of_dicts", None, None, "list_of_lists"]
    with pytest.raises(Exception, match="unknown payload format"):
        payload_rows(docs(spark, a, "[]"), "payload", FIELDS).collect()


def test_files_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"time_tag": "t1", "dst": 1.0}], indent=1))
    with gzip.open(tmp_path / "b.json.gz", "wt") as out:
        json.dump([{"time_tag": "t2", "dst": 2.0, "z": 0}], out)
    assert rows(read_dicts(spark, str(tmp_path), "time_tag string, dst double")) == [("t1", 1.0), ("t2", 2.0)]
    assert rows(payload_rows(read_documents(spark, str(tmp_path)), "payload", FIELDS)) == [("t1", 1.0), ("t2", 2.0)]


def test_parallel_and_nested_and_mirror(spark):
    df = docs(spark, {"datetime": ["2026-01-01T00:00:00Z", "2026-01-01T03:00:00Z"], "Kp": [1.33, None]})
    assert [tuple(r) for r in parallel_rows(df, "payload", "datetime", "Kp").collect()] == [
        ("2026-01-01T00:00:00", 1.33), ("2026-01-01T03:00:00", None),
    ]
    df = docs(spark, {"international_sunspot_number": {"samples": [{"time": "2026 01 02", "ssn": 7.0}]}})
    assert tuple(nested_samples(df, "payload").first()) == ("2026-01-02T00:00:00", 7.0)
    assert rename_mirror(spark.createDataFrame([("2026-01", 1.0)], "time_tag string, smoothed_ssn double")).columns == REQUIRED["smoothed_ssn"]


def test_grid_payload(spark):
    df = docs(spark, {"Observation Time": "o", "Forecast Time": "f", "coordinates": [[0, -90, 3], [359, 89, 0]]})
    assert [tuple(r) for r in grid_rows(df, "payload").collect()] == [("o", "f", 0, 0.0, -90.0, 3.0), ("o", "f", 1, 359.0, 89.0, 0.0)]


def record(day, values, head="DST2601*{:02d}RRX020"):
    line = head.format(day).ljust(16) + "   0" + "".join(str(v).rjust(4) for v in values) + " -12"
    return (line,)


def test_fixed_width(spark):
    lines = [
        record(3, [-12, 5, 9999, "", *range(20)]),
        ("<html>",),
        ("DST2601*04",),
        record(5, [9999] * 24),
    ]
    out = hourly_records(spark.createDataFrame(lines, "value string")).orderBy("time_tag").collect()
    assert len(out) == 22
    assert tuple(out[0]) == ("2026-01-03T00:00:00", -12.0) and tuple(out[2]) == ("2026-01-03T04:00:00", 0.0)


def test_marker(spark):
    mark = "**** OUTLOOK ****"
    texts = [f"head {mark} one {mark}\n two \n", "  plain ", f"x{mark}  ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(after_marker(F.col("t"), mark, "none")).collect()] == ["two", "plain", "none", "none", "none"]


def test_contracts(spark):
    good = spark.createDataFrame([("t", 1.0)], "time_tag string, Kp double")
    assert check_contract("kp", good) is good
    with pytest.raises(ContractError, match=r"missing \['Kp'\], received \['time_tag'\]"):
        check_contract("kp", good.drop("Kp"))
    with pytest.raises(ContractError, match="empty"):
        check_contract("kp", good.where("false"))
    assert first_valid("kp", [good.where("false"), good]) is good and first_valid("kp", [good.drop("Kp")]) is None


def test_drift_counts_every_record(spark):
    df = spark.createDataFrame([("a", '[{"x":1},{"y":2}]'), ("b", '[{"x":1}]')], "feed string, payload string")
    need = spark.createDataFrame([(f, c) for f in "ab" for c in "xyz"], "feed string, col string")
    assert sorted(tuple(r) for r in schema_drift(df, "feed", "payload", need).collect()) == [("a", "z"), ("b", "y"), ("b", "z")]


def test_fallback_choice(spark):
    c = spark.createDataFrame(
        [("kp", 1, "p", False), ("kp", 2, "f", True), ("dst", 1, "p", True), ("dst", 2, "f", True), ("ssn", 1, "p", False)],
        "feed string, rank int, path string, valid boolean",
    )
    assert {r.feed: (r.chosen, r.failed) for r in choose_feed(c).collect()} == {"kp": ("f", False), "dst": ("p", False), "ssn": (None, True)}


def test_lookback(frame):
    df = frame("ts TIMESTAMP_NTZ", [("2026-01-01",), ("2026-01-08",)])
    assert lookback_scan(df, "ts", 7, F.lit("2026-01-09").cast("timestamp_ntz")).count() == 1
    assert lookback_scan(df, "ts", 7).count() == 0
