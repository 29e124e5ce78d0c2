"""Raster steps and sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.carry import fill_gaps
from ..operators.raster import blur, fill_rows, grid_points, grid_summary, polar_smooth, rasterise
from ..operators.sequences import LinearScorer, score_batches, score_sequences, sequences
from ..plans.predict import predict
from . import adapters as A
from .registry import query

W, H = A.CELLS, A.HEIGHT
KEY = ["snap"]


@query("grid_points", f"""WITH {A.GRID} SELECT snap, lat, seq, value, CASE WHEN lon + 200 <= 180 THEN lon + 200 ELSE lon - 160 END AS lon
FROM cells WHERE value >= 2 AND abs(lat) >= 20""")
def points(spark, sf):
    cells = A.grid_cells(spark, sf).drop("label").withColumn("lon", F.col("lon") + 200)
    return grid_points(cells, "lon", "lat", "value")


@query(
    "grid_summary",
    f"WITH {A.GRID} SELECT snap, count(*) AS point_count, max(value) AS max_value FROM cells WHERE value >= 2 AND abs(lat) >= 20 GROUP BY snap",
)
def summary(spark, sf):
    return grid_summary(grid_points(A.grid_cells(spark, sf), "lon", "lat", "value"), KEY, "value")


def _raster(spark, sf):
    return rasterise(A.grid_cells(spark, sf), KEY, "lon", "lat", "value", "seq", W, H)


def _gappy(spark, sf):
    """All cells, those of the latitudes labelled 9 blank: they stand for rows the feed left out."""
    rows = A.grid_cells(spark, sf)
    raster = rasterise(rows, KEY, "lon", "lat", "value", "seq", W, H)
    blank = rows.groupBy("snap", (F.col("lat") + 90).alias("y")).agg(F.bool_and(F.col("label") == 9).alias("out"))
    marked = raster.join(blank, ["snap", "y"], "left")
    gone = F.coalesce("out", F.lit(False))
    zeros = F.transform("cells", lambda c: c * 0)
    return marked.select("snap", "y", F.when(gone, zeros).otherwise(F.col("cells")).alias("cells"), (F.col("populated") & ~gone).alias("populated"))


def _cells(rows):
    return rows.select("snap", F.col("y").cast("int").alias("y"), F.posexplode("cells").alias("x", "v"))


RASTER = f"""{A.GRID}, drawn AS (SELECT snap, (lat + 90)::INTEGER AS y, (lon + 32)::INTEGER AS x,
   floor(least(greatest(value, 0), 100) * 2.55::DOUBLE + 0.5) AS v FROM cells),
 frame AS (SELECT s.snap, y.y::INTEGER AS y, x.x::INTEGER AS x FROM (SELECT DISTINCT snap FROM cells) s,
   (SELECT unnest(generate_series(0, 180)) AS y) y, (SELECT unnest(generate_series(0, 63)) AS x) x),
 r0 AS (SELECT f.snap, f.y, f.x, coalesce(d.v, 0.0::DOUBLE) AS v, d.v IS NOT NULL AS populated
   FROM frame f LEFT JOIN drawn d ON f.snap = d.snap AND f.y = d.y AND f.x = d.x)"""
GAPPY_RASTER = f"""{RASTER.replace("r0 AS", "whole_r AS")}, gone AS (SELECT DISTINCT snap, (lat + 90)::INTEGER AS y FROM cells WHERE label = 9),
 r0 AS (SELECT w.snap, w.y, w.x, CASE WHEN g.y IS NULL THEN v ELSE 0.0::DOUBLE END AS v, populated AND g.y IS NULL AS populated
   FROM whole_r w LEFT JOIN gone g ON w.snap = g.snap AND w.y = g.y)"""
FILLED = f"""{GAPPY_RASTER}, near AS (SELECT *,
   last_value(CASE WHEN populated THEN y END IGNORE NULLS) OVER lo AS ly, last_value(CASE WHEN populated THEN v END IGNORE NULLS) OVER lo AS lv,
   first_value(CASE WHEN populated THEN y END IGNORE NULLS) OVER hi AS hy, first_value(CASE WHEN populated THEN v END IGNORE NULLS) OVER hi AS hv
   FROM r0 WINDOW lo AS (PARTITION BY snap, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
     hi AS (PARTITION BY snap, x ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 r1 AS (SELECT snap, y, x, CASE WHEN NOT populated AND ly IS NOT NULL AND hy IS NOT NULL AND hy - ly - 1 <= 2
   THEN floor(lv * (1 - (y - ly) / (hy - ly)::DOUBLE) + hv * ((y - ly) / (hy - ly)::DOUBLE) + 0.5) ELSE v END AS v FROM near)"""


def _blur_sql(source, out):
    return f"""{out}_h AS (SELECT snap, y, x, (coalesce(lag(v) OVER r, last_value(v) OVER whole) + 2 * v
     + coalesce(lead(v) OVER r, first_value(v) OVER whole)) / 4 AS v FROM {source}
   WINDOW r AS (PARTITION BY snap, y ORDER BY x),
     whole AS (PARTITION BY snap, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), {out} AS (
  SELECT snap, y, x, floor((coalesce(lag(v) OVER c, v) + 2 * v + coalesce(lead(v) OVER c, v)) / 4 + 0.5) AS v
  FROM {out}_h WINDOW c AS (PARTITION BY snap, x ORDER BY y))"""


BLURRED = f"{FILLED}, {_blur_sql('r1', 'b1')}, {_blur_sql('b1', 'b2')}"
POLAR = f"""{BLURRED}, spans AS (SELECT y, least(floor(1 / greatest(cos(radians((y - 90)::DOUBLE)), 1e-6::DOUBLE) + 0.5), 64)::INTEGER AS span,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (abs(y - 90) - 80) / 9.0::DOUBLE)) AS t
   FROM (SELECT unnest(generate_series(0, 180)) AS y)),
 means AS (SELECT b.snap, b.y, b.x, s.t * s.t * (3 - 2 * s.t) AS f, (sum(o.v) / any_value(s.span))::FLOAT::DOUBLE AS m
   FROM b2 b JOIN spans s ON b.y = s.y JOIN b2 o ON o.snap = b.snap AND o.y = b.y
     AND (o.x - (b.x - s.span // 2) + 128) % 64 < s.span GROUP BY b.snap, b.y, b.x, s.t),
 polar AS (SELECT snap, y, x, floor(m * (1 - f) + avg(m) OVER (PARTITION BY snap, y) * f + 0.5) AS v FROM means)"""


@query("rasterise", f"WITH {RASTER} SELECT snap, y, x, v FROM r0")
def raster(spark, sf):
    return _cells(_raster(spark, sf))


@query("raster_fill", f"WITH {FILLED} SELECT snap, y, x, v FROM r1")
def raster_fill(spark, sf):
    return _cells(fill_rows(_gappy(spark, sf), KEY))


@query("raster_blur", f"WITH {BLURRED} SELECT snap, y, x, v FROM b2")
def raster_blur(spark, sf):
    return _cells(blur(fill_rows(_gappy(spark, sf), KEY), KEY, 2, W))


@query("raster_polar", f"WITH {POLAR} SELECT snap, y, x, v FROM polar")
def raster_polar(spark, sf):
    return _cells(polar_smooth(blur(fill_rows(_gappy(spark, sf), KEY), KEY, 2, W), KEY, W, H))


# ---- sequences ----

LENGTH = 24


def _series(spark, sf):
    rows = fill_gaps(A.gappy(spark, sf), ["event_type"], "time", ["v", "k"], "full")
    return rows.select("event_type", "time", "v", "k")


_SERIES = f"{A.GAPPY}, {A.filled_sql('v', 'gappy', 'event_type', 'fv')}, {A.filled_sql('k', 'gappy', 'event_type', 'fk')}"
_SEQ = f"""{_SERIES}, q AS (SELECT event_type, time, list(v) OVER w AS vs, list(k) OVER w AS ks FROM fv JOIN fk USING (event_type, time)
 WINDOW w AS (PARTITION BY event_type ORDER BY time ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)),
 full_q AS (SELECT * FROM q WHERE len(vs) = {LENGTH})"""


@query(
    "seq_windows",
    f"WITH {_SEQ} SELECT event_type, time + INTERVAL 1 HOUR AS time, len(vs)::INTEGER AS n, vs[1] AS first_v, vs[{LENGTH}] AS last_v, list_max(ks) AS top_k FROM full_q",
)
def seq_windows(spark, sf):
    seqs = sequences(_series(spark, sf), ["event_type"], "time", ["v", "k"], LENGTH, 256)
    return seqs.select(
        "event_type",
        (F.col("time") + F.expr("INTERVAL 1 HOUR")).alias("time"),
        F.size("seq").alias("n"),
        F.col("seq")[0]["v"].alias("first_v"),
        F.col("seq")[LENGTH - 1]["v"].alias("last_v"),
        F.array_max("seq.k").alias("top_k"),
    )


def linear_scorer():
    """Weights 1/(age + 1) on v and 0.01 on k."""
    age = np.arange(LENGTH)[::-1]
    return LinearScorer(np.stack([1.0 / (age + 1.0), np.full(LENGTH, 0.01)], axis=1), 0.5)


_WEIGHTS = "[" + ", ".join(f"(1.0::DOUBLE / {LENGTH - i})" for i in range(LENGTH)) + "]"
_SCORE = f"list_dot_product(vs, {_WEIGHTS}::DOUBLE[]) + list_sum(ks) * 0.01::DOUBLE + 0.5::DOUBLE"


@query("score_linear", f"WITH {_SEQ} SELECT event_type, time, round({_SCORE}, 4) AS score FROM full_q")
def score_linear(spark, sf):
    scored = score_sequences(_series(spark, sf), ["event_type"], "time", ["v", "k"], linear_scorer(), LENGTH, 256, step="1 hour")
    return scored.withColumn("score", F.round("score", 4))


@query("score_arrays", f"WITH {_SEQ} SELECT event_type, time, round({_SCORE}, 4) AS score FROM full_q")
def score_arrays(spark, sf):
    seqs = sequences(_series(spark, sf), ["event_type"], "time", ["v", "k"], LENGTH, 256)
    arrays = seqs.withColumn("seq", F.transform("seq", lambda s: F.array(s["v"], s["k"])))
    return score_batches(arrays, "seq", linear_scorer()).withColumn("score", F.round("score", 4))


@query(
    "predictions",
    f"""WITH {_SEQ} SELECT event_type, time + INTERVAL 1 HOUR AS time,
  round_even(({_SCORE}) * 19.0::DOUBLE * 100 + (-8.0)::DOUBLE * 100, 0) / 100 AS dst_predictions FROM full_q""",
)
def predictions(spark, sf):
    return predict(_series(spark, sf), linear_scorer(), ["event_type"], ["v", "k"], LENGTH)
