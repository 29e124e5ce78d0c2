import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.select_source import SOURCE_PRIORITY, select_source, source_rank

DDL = "time_tag STRING, active BOOLEAN, source STRING, x DOUBLE, y DOUBLE"
T = "2026-01-01T00:00:00"


def picked(frame, rows):
    out = select_source(frame(DDL, rows), ["time_tag"], ["x", "y"]).collect()
    return {r.time_tag: (r.x, r.y) for r in out}


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(T, True, "ACE", 1.5, 1.5), (T, False, "DSCOVR", 9.9, 9.9)], (1.5, 1.5)),
        ([(T, True, "ACE", None, None), (T, False, "DSCOVR", 9.9, 9.9)], (9.9, 9.9)),
        ([(T, True, "ACE", None, None), (T, False, "DSCOVR", None, None)], (None, None)),
        ([(T, True, "ACE", None, None), (T, False, "DSCOVR", 9.9, None)], (None, None)),
        ([(T, True, "ACE", 1.0, None), (T, False, "DSCOVR", 9.9, 9.9)], (1.0, None)),
        ([(T, False, "ACE", 2.0, None)], (2.0, None)),
        ([(T, True, "SOLAR1", 1.5, 1.5), (T, True, "ACE", 9.9, 9.9)], (1.5, 1.5)),
        ([(T, False, "SOLAR1", 1.5, 1.5), (T, False, "ACE", 9.9, 9.9)], (1.5, 1.5)),
        ([(T, True, "SOLAR1", None, None), (T, False, "ACE", 9.9, 9.9), (T, False, "DSCOVR", 5.5, 5.5)], (9.9, 9.9)),
        ([(T, False, "SOLAR1", None, None), (T, False, "ACE", 9.9, 9.9)], (9.9, 9.9)),
        ([(T, True, "SOLAR1", 1.0, None), (T, True, "ACE", 2.0, 3.0)], (1.0, 3.0)),
    ],
)
def test_cases(frame, rows, want):
    assert picked(frame, rows) == {T: want}


def restated(rows):
    """Plain restatement of the rule, timestamp by timestamp."""
    out = {}
    for time in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == time), key=lambda r: SOURCE_PRIORITY.get(r[2], 999))

        def first(side, i):
            return next((r[i] for r in mine if r[1] is side and r[i] is not None), None)

        active = (first(True, 3), first(True, 4))
        inactive = (first(False, 3), first(False, 4))
        has_active = any(r[1] for r in mine)
        complete = any(not r[1] and r[3] is not None and r[4] is not None for r in mine)
        swap = not has_active or (active == (None, None) and complete)
        out[time] = inactive if swap else active
    return out


def test_random_against_restatement(frame):
    rng = random.Random(5)
    value = lambda: None if rng.random() < 0.5 else round(rng.uniform(0, 9), 2)
    rows = [
        (f"t{t}", rng.random() < 0.5, s, value(), value())
        for t in range(400)
        for s in rng.sample(["SOLAR1", "IMAP", "ACE", "DSCOVR", "OTHER"], rng.randint(1, 5))
    ]
    assert picked(frame, rows) == restated(rows)


def test_one_hot_timestamp_and_hash_aggregation(spark):
    """A third of all rows on one timestamp combines before the exchange."""
    rows = spark.range(9000).select(
        F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") / 4).cast("int"))).alias("time_tag"),
        (F.col("id") > 10).alias("active"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCE_PRIORITY]), (F.col("id") % 4 + 1).cast("int")).alias("source"),
        F.when(F.col("id") % 2 == 1, F.col("id") % 4 * 1.0).alias("x"),
        F.lit(1.0).alias("y"),
    )
    out = select_source(rows, ["time_tag"], ["x", "y"])
    assert out.where("time_tag = 'hot'").first().x == 1.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_min_by" in plan


def test_unknown_sources_rank_after_known(frame):
    rows = frame("source STRING", [(s,) for s in ("DSCOVR", "SOLAR1", "X", "Y")])
    ranks = {r.source: r.k for r in rows.select("source", source_rank(F.col("source")).alias("k")).collect()}
    assert ranks["SOLAR1"] < ranks["DSCOVR"] < min(ranks["X"], ranks["Y"]) and ranks["X"] != ranks["Y"]
