import math
import os
import pathlib
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.raster import blur, fill_rows, polar_smooth, rasterise, texture
from tidemark.operators.sequences import LinearScorer, OnnxScorer, score_batches, score_sequences, sequences
from tidemark.plans.predict import predict

ROOT = str(pathlib.Path(__file__).resolve().parents[1])
W, H = 360, 181


def half_up(x):
    return np.floor(x + 0.5)


def sample_points(seed):
    """(lon, lat, value): two ovals with missing rows, an isolated row and repeated cells."""
    rng = np.random.default_rng(seed)
    rows = [lat for lat in [*range(55, 91), *range(-90, -60), 0] if lat not in (-89, 89, 70, 71, 60, 61, 62)]
    points = [(int(x) - 180, lat, int(v)) for lat in rows for x, v in zip(rng.choice(W, 200, False), rng.integers(0, 130, 200))]
    return points + points[:50:5]


def brute(points):
    """The whole raster chain over a dense array."""
    data, seen = np.zeros((H, W)), np.zeros(H, bool)
    for lon, lat, p in points:
        y = min(H - 1, max(0, int(half_up(lat)) + 90))
        data[y, (int(half_up(lon)) + 180) % W] = half_up(min(100, max(0, p)) * 2.55)
        seen[y] = True
    stages = [data.copy()]
    known = np.flatnonzero(seen)
    for y in np.flatnonzero(~seen):
        lo, hi = known[known < y], known[known > y]
        if len(lo) and len(hi) and hi[0] - lo[-1] - 1 <= 2:
            t = (y - lo[-1]) / (hi[0] - lo[-1])
            data[y] = half_up(stages[0][lo[-1]] * (1 - t) + stages[0][hi[0]] * t)
    stages.append(data.copy())
    for _ in range(2):
        h = (np.roll(data, 1, 1) + 2 * data + np.roll(data, -1, 1)) / 4
        padded = np.vstack([h[:1], h, h[-1:]])
        data = half_up((padded[:-2] + 2 * h + padded[2:]) / 4)
    stages.append(data.copy())
    out = np.empty_like(data)
    for y in range(H):
        lat = y - 90
        n = min(int(half_up(1 / max(math.cos(math.radians(lat)), 1e-6))), W)
        row = data[y]
        if n > 1:
            idx = (np.arange(W)[:, None] - (n >> 1) + np.arange(n)[None, :]) % W
            row = (row[idx].sum(1) / n).astype(np.float32).astype(float)
        t = max(0.0, min(1.0, (abs(lat) - 80) / 9))
        f = t * t * (3 - 2 * t)
        mean = 0.0
        for v in row:
            mean += v
        out[y] = half_up(row * (1 - f) + mean / W * f)
    return [*stages, out]


def test_raster_chain_equals_dense_arrays(spark):
    archive = {"a": sample_points(1), "b": sample_points(2)}
    rows = [(k, i, *p) for k, points in archive.items() for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "snap string, seq int, lon int, lat int, value int")
    raster = rasterise(df, ["snap"], "lon", "lat", "value", "seq")
    filled = fill_rows(raster, ["snap"])
    blurred = blur(filled, ["snap"])
    got = [raster, filled, blurred, polar_smooth(blurred, ["snap"])]
    for key, points in archive.items():
        for df_, want in zip(got, brute(points)):
            cells = df_.where(F.col("snap") == key).orderBy("y").select("cells").collect()
            assert np.array_equal(np.array([c[0] for c in cells]), want)
    assert texture(df, ["snap"], "lon", "lat", "value", "seq").count() == 2 * H


def hours(spark, n, keys=("a",), missing=()):
    base = F.lit("2026-01-01").cast("timestamp_ntz")
    rows = [(k, h, float(h % 13), float(h)) for k in keys for h in range(n) if h not in missing]
    df = spark.createDataFrame(rows, "k string, h int, x double, y double")
    return df.select("k", (base + F.make_dt_interval(F.lit(0), F.col("h"))).alias("time"), "x", "y")


@pytest.mark.parametrize("rows, want", [(200, 33), (170, 3), (167, 0)])
def test_window_counts(spark, rows, want):
    assert sequences(hours(spark, rows), ["k"], "time", ["x", "y"]).count() == want


@pytest.mark.parametrize("block", [24, 50, 4096])
def test_sequences_and_scores_against_brute_force(spark, block):
    df = hours(spark, 300, ("a", "b"), missing=range(40, 95))  # a gap shortens no lead-in
    weights = np.arange(48.0).reshape(24, 2) / 10
    want = {}
    for key, pdf in df.toPandas().sort_values("time").groupby("k"):
        cells = pdf[["x", "y"]].to_numpy()
        for i in range(23, len(pdf)):
            want[key, pdf.time.iloc[i]] = cells[i - 23 : i + 1]
    seqs = sequences(df, ["k"], "time", ["x", "y"], 24, block, "1 day")
    got = {(r.k, pd.Timestamp(r.time)): np.array([list(s) for s in r.seq]) for r in seqs.collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    scored = score_sequences(df, ["k"], "time", ["x", "y"], LinearScorer(weights, 1.0), 24, block, "1 day", batch=7)
    scores = {(r.k, pd.Timestamp(r.time)): r.score for r in scored.collect()}
    assert scores.keys() == want.keys()
    assert all(math.isclose(scores[k], (want[k] * weights).sum() + 1) for k in want)
    arrays = seqs.withColumn("seq", F.transform("seq", lambda s: F.array(s["x"], s["y"])))
    again = {(r.k, pd.Timestamp(r.time)): r.score for r in score_batches(arrays, "seq", LinearScorer(weights, 1.0)).collect()}
    assert again.keys() == want.keys() and all(math.isclose(again[k], scores[k]) for k in want)


def test_prediction_time_and_scale(spark):
    flat = hours(spark, 170).withColumn("x", F.lit(0.0))
    out = predict(flat, LinearScorer(np.zeros((168, 2)), 1.0), ["k"], ["x", "y"]).orderBy("time").collect()
    assert len(out) == 3 and str(out[0].time) == "2026-01-08 00:00:00" and {r.dst_predictions for r in out} == {11.0}


def varint(n):
    out = b""
    while True:
        out += bytes([(n & 0x7F) | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def mean_model():
    """An ONNX file that averages every sequence: ReduceMean over axes 1 and 2."""
    axes = field(5, field(1, "axes") + field(8, 1) + field(8, 2) + field(20, 7))
    keep = field(5, field(1, "keepdims") + field(3, 0) + field(20, 2))
    node = field(1, "input_layer:0") + field(2, "out") + field(4, "ReduceMean") + axes + keep

    def tensor(name, dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    graph = field(1, node) + field(2, "g") + field(11, tensor("input_layer:0", ["n", 24, 2])) + field(12, tensor("out", ["n"]))
    return field(1, 7) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_onnx_scorer(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    path = tmp_path / "mean.onnx"
    path.write_bytes(mean_model())
    df = hours(spark, 60)
    scored = score_sequences(df, ["k"], "time", ["x", "y"], OnnxScorer(str(path)), 24, 30, "1 day").orderBy("time").collect()
    cells = df.orderBy("time").toPandas()[["x", "y"]].to_numpy()
    want = [cells[i - 23 : i + 1].mean() for i in range(23, 60)]
    assert np.allclose([r.score for r in scored], want, rtol=1e-5)


def test_scoring_needs_no_installed_package(tmp_path):
    """Workers started elsewhere, without this package on their path, can still score."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import numpy as np
from tidemark.operators.sequences import LinearScorer, score_sequences
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.range(30).selectExpr("'a' AS k", "timestamp_ntz'2026-01-01' + make_dt_interval(0, CAST(id AS INT)) AS time", "id * 1.0D AS x")
print("rows", score_sequences(df, ["k"], "time", ["x"], LinearScorer(np.ones((24, 1))), 24, 24).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 7" in done.stdout, done.stderr[-2000:]
