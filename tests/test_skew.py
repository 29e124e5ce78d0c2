"""One key, time, value or group of copies holding a third of the rows or more."""

import re

from pyspark.sql import functions as F

from tidemark.operators.buckets import complete_bucket_mean
from tidemark.operators.carry import fill_gaps, spread, tail_rows
from tidemark.operators.clean import mask_and_fill
from tidemark.operators.merge import last_wins, merge_records
from tidemark.operators.publish import diff_upsert, slice_interval
from tidemark.operators.sequences import LinearScorer, score_sequences

MINUTE = "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST({} AS INT))"


def series(spark, n=40_000):
    """Key 'hot' holds nearly all rows; 20 other keys hold 50 each."""
    hot = spark.range(n).selectExpr("'hot' AS k", f"{MINUTE.format('id')} AS time", "CASE WHEN id % 3 > 0 THEN id % 97 * 1.0D END AS v")
    rest = spark.range(1000).selectExpr("concat('k', id % 20) AS k", f"{MINUTE.format('id')} AS time", "id * 1.0D AS v")
    return hot.unionByName(rest)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_one_series_spreads_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = spread(series(spark), ["k"], "time", "1 day")
        assert largest_share(parts) < 0.5
        groups = parts.groupBy("k", "_bucket").count().agg(F.max("count")).first()[0]
        assert groups <= 1440
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_window_sees_a_whole_series(spark):
    """Every window over detail rows is partitioned by the bucket; only summaries go by key alone."""
    df = series(spark)
    for out in (fill_gaps(df, ["k"], "time", ["v"]), mask_and_fill(df, ["k"], "time", ["v"], step="1 minute")):
        plan = plan_of(out)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        windows = re.findall(r"windowspecdefinition\(([^)]*?)specifiedwindowframe", plan)
        detail = [w for w in windows if "time#" in w]
        assert detail and all("_bucket#" in w for w in detail)


def test_hot_series_results(spark):
    df = series(spark)
    out = fill_gaps(df, ["k"], "time", ["v"]).where("k = 'hot'")
    assert out.count() == 40_000 and out.where("v IS NULL").isEmpty()
    assert tail_rows(df, 5000, "time", ["k"]).where("k = 'hot'").count() == 5000
    scored = score_sequences(df.na.fill(0.0), ["k"], "time", ["v"], LinearScorer([[1.0]] * 24), 24, 1000)
    assert scored.where("k = 'hot'").count() == 40_000 - 23
    assert complete_bucket_mean(df, ["k"], "time", ["v"]).where("k = 'hot'").count() == 40_000 // 60


def test_copies_collapse_before_the_exchange(spark):
    copies = spark.range(30_000).selectExpr("CASE WHEN id < 15000 THEN 0 ELSE id END AS k", "id AS seq", "id * 1.0D AS v")
    out = last_wins(copies, ["k"], "seq")
    assert out.where("k = 0").first().v == 14999.0 and out.count() == 15001
    plan = plan_of(out)
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_max_by") and "SortAggregate" not in plan
    merged = merge_records(copies.limit(0).drop("seq"), copies, ["k"], "seq")
    assert merged.where("k = 0").first().v == 14999.0 and "SortAggregate" not in plan_of(merged)


def test_slices_and_upserts_of_a_hot_key(spark):
    df = series(spark)
    assert slice_interval(df, "time", "24 hours", ["k"]).where("k = 'hot'").count() == 1441
    base = df.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    again = diff_upsert(base, df, ["k", "time"], ["v"], now)
    assert again.where("month(updated_at) = 2").isEmpty() and again.count() == 41_000
