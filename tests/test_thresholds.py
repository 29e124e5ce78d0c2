"""Thresholds over a whole history from tables that add up by month."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.clean import mask_outliers
from tidemark.operators.quantile import quantiles
from tidemark.operators.thresholds import EDGE, published_thresholds, update_rates

COLS = ["v", "w"]


def history(spark, seed, months=4, step=6):
    """Two series on a grid of `step` hours, one two months behind, with gaps in the values and ties."""
    rng, rows = random.Random(seed), []
    for key, first, last in (("new", 0, months), ("old", 0, months - 2)):
        for hour in range(first * 30 * 24, last * 30 * 24, step):
            v = None if rng.random() < 0.1 else round(rng.gauss(0, 5) * (10 if rng.random() < 0.02 else 1), 2)
            rows.append((key, hour, v, float(rng.randint(0, 6))))
    df = spark.createDataFrame(rows, "k string, h int, v double, w double")
    return df.selectExpr("k", "timestamp_ntz'2026-01-01' + make_dt_interval(0, h) AS time", "v", "w")


def months_of(df):
    return df.withColumn("m", F.date_format("time", "yyyy-MM"))


def table(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("step", ["6 hours", None])
@pytest.mark.parametrize("keys", [["k"], []])
def test_months_add_up_to_the_whole(spark, tmp_path, keys, step):
    root = str(tmp_path)
    rows = months_of(history(spark, 5)).where("k = 'new'" if not keys else "true").persist()
    wrong = rows.withColumn("v", F.when(F.col("m") == "2026-03", F.col("v") * 50).otherwise(F.col("v")))
    update_rates(spark, root, wrong.where("m <= '2026-03'"), keys, "time", COLS, "30 days", step)
    recent = rows.where("m >= '2026-03'").drop("m")
    for _ in range(2):  # a repetition changes nothing
        led = update_rates(spark, root, recent, keys, "time", COLS, "30 days", step)
    got = published_thresholds(spark, root, keys, COLS)
    full = mask_outliers(rows.drop("m"), keys, "time", COLS, width="30 days", step=step)
    masked = mask_outliers(led, keys, "time", COLS, width="30 days", step=step, thresholds=got).where(f"NOT {EDGE}")
    order = [*keys, "time", *COLS]
    key = lambda df: sorted(map(repr, (tuple(r[c] for c in order) for r in df.collect())))
    # The series that lags is masked by the same limits, though the run has not read it.
    assert key(masked) == key(full.join(recent.select(*keys, "time"), [*keys, "time"]))
    assert masked.count() == recent.count() and got.count() == len(set(rows.select(*keys).distinct().collect())) if keys else got.count() == 1
    rows.unpersist()


def test_only_the_bins_of_the_rank_are_read(spark, tmp_path):
    root = str(tmp_path)
    rows = history(spark, 8, months=3)
    update_rates(spark, root, rows, ["k"], "time", COLS, "30 days", "6 hours")
    plan = published_thresholds(spark, root, ["k"], COLS)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan") if f"{root}/values" in x]
    assert scans and all("PushedFilters: [" in x and "_bin" in x.split("PushedFilters: [")[1].split("]")[0] + x.split("DataFilters: [")[1][:400] for x in scans)


def test_a_run_reads_no_earlier_month(spark, tmp_path):
    """The rows of the first months may be gone: the limits of all months stay."""
    root, rows = str(tmp_path), months_of(history(spark, 2)).persist()
    update_rates(spark, root, rows.where("m < '2026-03'"), ["k"], "time", COLS, "30 days", "6 hours")
    update_rates(spark, root, rows.where("m >= '2026-03'"), ["k"], "time", COLS, "30 days", "6 hours")
    got = {r.k: (r.v, r.w) for r in published_thresholds(spark, root, ["k"], COLS, 0.9).collect()}
    lagged = rows.selectExpr("k", *[f"abs({c} - lag({c}) OVER (PARTITION BY k ORDER BY time)) AS {c}" for c in COLS])
    assert got == {r.k: (r.v, r.w) for r in quantiles(lagged, ["k"], COLS, 0.9).collect()}
    rows.unpersist()


def test_a_gap_before_the_first_month_gives_no_rate(spark, tmp_path):
    """On a grid the edge counts only if it is the step before."""
    root = str(tmp_path)
    grid = spark.range(40).selectExpr("'a' AS k", "timestamp_ntz'2026-01-22' + make_dt_interval(0, CAST(id * 6 AS INT)) AS time", "id * 1.0D AS v", "1.0D AS w")
    update_rates(spark, root, grid, ["k"], "time", COLS, "30 days", "6 hours")
    later = grid.selectExpr("k", "time + INTERVAL 60 DAYS AS time", "v + 1000 AS v", "w")
    led = update_rates(spark, root, later, ["k"], "time", COLS, "30 days", "6 hours")
    assert led.where(EDGE).count() == 0 and published_thresholds(spark, root, ["k"], COLS, 1.0).first().v == 1.0
    led = update_rates(spark, root, later, ["k"], "time", COLS, "30 days", None)
    assert led.where(EDGE).count() == 1 and published_thresholds(spark, root, ["k"], COLS, 1.0).first().v == 961.0
