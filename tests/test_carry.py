import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.carry import (
    fill_gaps,
    grid_position,
    latest_row,
    measured_width,
    positions,
    rate_of_change,
    tail_rows,
)
from tidemark.operators.clean import mask_and_fill, mask_outliers
from tidemark.operators.quantile import quantiles

SETTINGS = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def series(seed=1, n=1500, days=12, holes=0.3, regular=False):
    rng = np.random.default_rng(seed)
    minutes = np.arange(n) if regular else np.sort(rng.choice(60 * 24 * days, n, replace=False))
    v = rng.normal(size=n).cumsum()
    v[rng.random(n) < holes] = np.nan
    v[:7] = v[-9:] = np.nan
    v[n // 3 : n // 2] = np.nan
    return pd.DataFrame({"time": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, unit="m"), "v": v})


def load(spark, parts):
    """{key: frame} as one shuffled DataFrame(k, time, v)."""
    pdf = pd.concat([p.assign(k=k) for k, p in parts.items()]).sample(frac=1, random_state=3)
    rows = [(k, t.to_pydatetime(), None if np.isnan(v) else float(v)) for k, t, v in zip(pdf.k, pdf.time, pdf.v)]
    return spark.createDataFrame(rows, "k string, time timestamp_ntz, v double")


def values(df, key, col="v"):
    return df.where(F.col("k") == key).orderBy("time").toPandas()[col].to_numpy(dtype=float)


def same(a, b):
    return np.array_equal(a, np.asarray(b, dtype=float), equal_nan=True)


@pytest.mark.parametrize("how", ["linear", "forward", "backward", "full"])
def test_fills_match_pandas_bit_for_bit(spark, how):
    a, b = series(1), series(2)
    out = fill_gaps(load(spark, {"a": a, "b": b}), ["k"], "time", ["v"], how)
    want = {
        "linear": lambda s: s.interpolate(),
        "forward": lambda s: s.ffill(),
        "backward": lambda s: s.bfill(),
        "full": lambda s: s.interpolate().ffill().bfill(),
    }[how]
    for key, pdf in (("a", a), ("b", b)):
        assert same(values(out, key), want(pdf.v))


@settings(**SETTINGS)
@given(width=st.sampled_from(["10 minutes", "7 hours", "1 day", "5 days", "365 days"]), seed=st.integers(0, 50))
def test_bucket_width_never_changes_the_result(spark, width, seed):
    pdf = series(seed, n=300, days=3)
    df = load(spark, {"a": pdf})
    assert same(values(fill_gaps(df, ["k"], "time", ["v"], "full", width), "a"), pdf.v.interpolate().ffill().bfill())
    assert same(values(rate_of_change(df, ["k"], "time", ["v"], width), "a", "v_roc"), pdf.v.diff().abs())


def test_all_null_and_single_row_series(spark):
    empty = series(1, 200, 2)
    empty["v"] = np.nan
    one = series(1, 200, 2).iloc[[50]].assign(v=4.0)
    out = fill_gaps(load(spark, {"e": empty, "o": one}), ["k"], "time", ["v"], "full")
    assert np.isnan(values(out, "e")).all() and values(out, "o").tolist() == [4.0]


def test_reference_interpolation_case(frame):
    rows = [(f"2024-01-01 00:0{i}:00", v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, None, None, 7.0, 8.0, 9.0])]
    out = fill_gaps(frame("time TIMESTAMP_NTZ, speed DOUBLE", rows), [], "time", ["speed"], "linear")
    assert [r.speed for r in out.orderBy("time").collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_grid_position_equals_counted_position(spark):
    pdf = series(4, 3000, regular=True)
    df = load(spark, {"a": pdf})
    counted = values(fill_gaps(df, ["k"], "time", ["v"], "full"), "a")
    placed = values(fill_gaps(df, ["k"], "time", ["v"], "full", position=grid_position("time", "1 minute")), "a")
    assert same(counted, placed)


def masked(s, q=0.97):
    roc = s.diff().abs()
    return s.where(~(roc > roc.quantile(q)))


def test_outlier_mask_and_fill_match_pandas(spark):
    a, b = series(5, regular=True), series(6, regular=True)
    df = load(spark, {"a": a, "b": b})
    for step in (None, "1 minute"):
        out = mask_outliers(df, ["k"], "time", ["v"], step=step)
        both = mask_and_fill(df, ["k"], "time", ["v"], step=step)
        for key, pdf in (("a", a), ("b", b)):
            assert same(values(out, key), masked(pdf.v))
            assert same(values(both, key), masked(pdf.v).interpolate().ffill().bfill())


def test_published_thresholds_replace_measured_ones(spark):
    pdf = series(7, regular=True)
    limits = spark.createDataFrame([("a", 0.5)], "k string, v double")
    out = mask_outliers(load(spark, {"a": pdf}), ["k"], "time", ["v"], thresholds=limits)
    assert same(values(out, "a"), pdf.v.where(~(pdf.v.diff().abs() > 0.5)))


@pytest.mark.parametrize("q", [0.0, 0.03, 0.5, 0.97, 1.0])
def test_quantile_matches_pandas_bit_for_bit(spark, q):
    a, b = series(8), series(9)
    b["v"] = (b.v * 3).round(0)  # many equal values
    out = {r.k: r.v for r in quantiles(load(spark, {"a": a, "b": b}), ["k"], ["v"], q).collect()}
    assert out == {"a": a.v.quantile(q), "b": b.v.quantile(q)}


def test_quantile_with_one_hot_value(spark):
    """Half of the rows carry the same value; it is counted, not gathered."""
    rows = spark.range(20000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("v"))
    want = pd.Series([0.0 if i % 2 == 0 else float(i) for i in range(20000)]).quantile(0.97)
    assert quantiles(rows, [], ["v"], 0.97).first().v == want
    near = quantiles(rows, [], ["v"], 0.97, approx=True).first().v
    assert abs(near - want) < 20


def test_positions_tail_latest(spark):
    a, b = series(10), series(11, n=40)
    df = load(spark, {"a": a, "b": b})
    placed = positions(df, ["k"], "time").where("k = 'a'").orderBy("time").toPandas()
    assert placed.pos.tolist() == list(range(len(a)))
    tail = tail_rows(df, 100, "time", ["k"], "1 day").toPandas()
    assert sorted(tail[tail.k == "a"].time) == list(a.time[-100:]) and (tail.k == "b").sum() == 40
    newest = {r.k: r.time for r in latest_row(df, "time", ["k"]).collect()}
    assert newest == {"a": a.time.iloc[-1], "b": b.time.iloc[-1]}


def test_cycle_tail(spark):
    days = spark.range(5000).select(
        F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("time"),
        F.col("id").cast("double").alias("swpc_ssn"),
    )
    out = tail_rows(days, 4383, "time").agg(F.count("*"), F.min("swpc_ssn"), F.max("swpc_ssn")).first()
    assert tuple(out) == (4383, 617.0, 4999.0)


def test_measured_width_shrinks_for_a_dense_bucket(spark):
    dense = spark.range(5000).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("time")
    )
    assert measured_width(dense, [], "time", 10_000) == "365 days"
    assert measured_width(dense, [], "time", 4_000) == "1 hour"
    assert measured_width(dense, [], "time", 100) == "1 minute"


def test_width_can_be_measured(spark):
    pdf = series(3, n=300, days=3)
    df = load(spark, {"a": pdf})
    assert same(values(fill_gaps(df, ["k"], "time", ["v"], "full", None), "a"), pdf.v.interpolate().ffill().bfill())
    assert same(values(mask_outliers(df, ["k"], "time", ["v"], width=None), "a"), masked(pdf.v))
    assert tail_rows(df, 10, "time", ["k"], None).count() == 10
    assert positions(df, ["k"], "time", None).agg(F.max("pos")).first()[0] == 299


def test_asof(spark, frame):
    solar = frame(
        "time TIMESTAMP_NTZ, x DOUBLE",
        [("2026-04-30 23:58:00", 1.0), ("2026-04-30 23:59:00", 2.0), ("2026-05-01 00:00:00", 3.0), ("2026-05-01 00:01:00", 4.0)],
    )
    monthly = frame("time TIMESTAMP_NTZ, predicted_ssn DOUBLE", [("2026-04-01", 57.9), ("2026-05-01", 58.5), ("2026-07-01", 60.0)])
    out = asof_join(solar, monthly, [], "time", ["predicted_ssn"], unique_left=True).orderBy("time").collect()
    assert [(r.x, r.predicted_ssn) for r in out] == [(1.0, 57.9), (2.0, 57.9), (3.0, 58.5), (4.0, 58.5)]
    early = frame("time TIMESTAMP_NTZ, x DOUBLE", [("2026-03-01", 9.0)])
    assert asof_join(early, monthly, [], "time", ["predicted_ssn"]).isEmpty()


def test_asof_with_repeated_and_hot_left_times(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(5)).otherwise(F.col("id") % 40).alias("h"), F.col("id")
    ).select("id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h").cast("int"))).alias("time"))
    right = spark.range(0, 40, 3).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("time"),
        F.col("id").cast("double").alias("r"),
    )
    got = asof_join(left, right, [], "time", ["r"], "1 hour").toPandas().sort_values("id")
    want = pd.merge_asof(left.toPandas().sort_values("time"), right.toPandas().sort_values("time"), on="time").sort_values("id")
    assert len(got) == 3000 and got.r.tolist() == want.r.tolist()
