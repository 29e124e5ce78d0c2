"""Grid snapshots: points to rows of cells, gap rows, blur and polar smoothing.

A snapshot is `height` rows, each an array of `width` cells, so every per-row step is an array
expression and every neighbour-row step is a window over one snapshot's rows. The window size is
the grid height, never the data size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import wrap_longitude

# Fixed values of the display grid.
WIDTH, HEIGHT = 360, 181
MIN_PROBABILITY, MIN_ABS_LATITUDE = 2, 20
MAX_BRIDGE = 2
FLATTEN_FROM, FLATTEN_TO = 80, 89


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def _let(value: Column, body) -> Column:
    """body(value) with `value` computed once per row, even where body uses it per cell."""
    return F.transform(F.array(value), body)[0]


def grid_points(df: DataFrame, lon: str, lat: str, value: str, floor: float = MIN_PROBABILITY, min_lat: float = MIN_ABS_LATITUDE) -> DataFrame:
    """The points worth drawing, longitudes in -180..180."""
    shown = df.where((F.col(value) >= floor) & (F.abs(F.col(lat)) >= min_lat))
    return shown.withColumn(lon, wrap_longitude(F.col(lon)))


def grid_summary(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.count("*").alias("point_count"), F.coalesce(F.max(value), F.lit(0)).alias("max_value")
    )


def rasterise(
    points: DataFrame, keys: list[str], lon: str, lat: str, value: str, seq: str, width: int = WIDTH, height: int = HEIGHT
) -> DataFrame:
    """(keys, y, cells, populated): one array of cell bytes per latitude; the last point wins.

    Every snapshot gets all `height` rows; a row without points holds zeros and populated = false.
    """
    x = F.pmod(F.floor(F.col(lon) + 0.5) + width // 2, F.lit(width)).cast("int")
    y = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.floor(F.col(lat) + 0.5) + (height - 1) // 2)).cast("int")
    byte = _round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(value).cast("double"))) * 2.55)
    cells = points.select(*keys, x.alias("x"), y.alias("y"), byte.alias("v"), F.col(seq).alias("_s"))
    cells = cells.groupBy(*keys, "y", "x").agg(F.max_by("v", "_s").alias("v"))
    # At most `width` cells per row.
    drawn = cells.groupBy(*keys, "y").agg(F.collect_list(F.struct("x", F.lit(0).alias("missing"), "v")).alias("seen"))
    rows = points.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    blank = F.expr(f"transform(sequence(0, {width - 1}), x -> struct(x AS x, 1 AS missing, 0.0D AS v))")
    ordered = F.array_sort(F.concat(F.coalesce("seen", F.slice(blank, 1, 0)), blank))
    first_per_x = lambda all_: F.filter(all_, lambda c, i: (i == 0) | (c["x"] != F.get(all_, i - 1)["x"]))
    return rows.join(drawn, [*keys, "y"], "left").select(
        *keys, "y", _let(ordered, first_per_x).getField("v").alias("cells"), F.col("seen").isNotNull().alias("populated")
    )


def fill_rows(rows: DataFrame, keys: list[str], max_bridge: int = MAX_BRIDGE) -> DataFrame:
    """Interpolates runs of at most `max_bridge` missing rows that have data on both sides."""
    known = F.when(F.col("populated"), F.struct("y", "cells"))
    upward = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy(*keys).orderBy(F.col("y").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_lo", F.last(known, True).over(upward)).withColumn("_hi", F.last(known, True).over(downward))
    lo, hi = F.col("_lo"), F.col("_hi")
    gap = hi["y"] - lo["y"]
    t = (F.col("y") - lo["y"]) / gap
    lerp = F.zip_with(lo["cells"], hi["cells"], lambda a, b: _round(a * (1 - t) + b * t))
    bridged = ~F.col("populated") & lo.isNotNull() & hi.isNotNull() & (gap - 1 <= max_bridge)
    return near.select(*keys, "y", F.when(bridged, lerp).otherwise(F.col("cells")).alias("cells"))


def blur(rows: DataFrame, keys: list[str], passes: int = 2, width: int = WIDTH) -> DataFrame:
    """Separable [1,2,1]/4 blur: wraps along the row, clamps at the first and last row."""
    order = Window.partitionBy(*keys).orderBy("y")
    spots = F.sequence(F.lit(1), F.lit(width))

    def along(ring: Column) -> Column:
        at = lambda i: F.element_at(ring, i)
        return F.transform(spots, lambda i: (at(i) + at(i + 1) * 2 + at(i + 2)) / 4)

    for _ in range(passes):
        cells = F.col("cells")
        ring = F.concat(F.slice(cells, width, 1), cells, F.slice(cells, 1, 1))
        across = rows.select(*keys, "y", _let(ring, along).alias("_h"))
        around = across.withColumn("_u", F.coalesce(F.lag("_h").over(order), F.col("_h"))).withColumn(
            "_d", F.coalesce(F.lead("_h").over(order), F.col("_h"))
        )
        sides = F.zip_with("_u", "_d", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        mixed = F.zip_with("_h", sides, lambda c, s: _round((s["a"] + c * 2 + s["b"]) / 4))
        rows = around.select(*keys, "y", mixed.alias("cells"))
    return rows


def polar_smooth(rows: DataFrame, keys: list[str], width: int = WIDTH, height: int = HEIGHT, pole: int = 90) -> DataFrame:
    """Circular mean as wide as the row's longitude spacing needs, blended to the row mean near the poles."""
    lat = (F.col("y") - (height - 1) // 2) * F.lit(float(pole) / ((height - 1) // 2))
    scale = F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    span = F.least(F.floor(1 / scale + 0.5), F.lit(width)).cast("int")
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.abs(lat) - FLATTEN_FROM) / float(FLATTEN_TO - FLATTEN_FROM)))
    blend = ramp * ramp * (3 - 2 * ramp)
    given = F.struct(
        F.concat("cells", "cells", "cells").alias("ring"),
        F.col("cells"),
        span.alias("span"),
        F.floor(span / 2).cast("int").alias("half"),
        blend.alias("blend"),
    )

    def widened(g: Column) -> Column:
        def mean_at(i: Column) -> Column:
            around = F.slice(g["ring"], F.lit(width + 1) + i - g["half"], g["span"])
            # Kept in single precision between the two steps, as the display does.
            return (F.aggregate(around, F.lit(0.0), lambda a, c: a + c) / g["span"]).cast("float").cast("double")

        means = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), mean_at)
        return F.when(g["span"] > 1, means).otherwise(g["cells"])

    def blended(g: Column) -> Column:
        def mix(r: Column) -> Column:
            mean = F.aggregate(r, F.lit(0.0), lambda a, c: a + c) / width
            return _let(mean, lambda m: F.transform(r, lambda c: _round(c * (1 - g["blend"]) + m * g["blend"])))

        return _let(widened(g), mix)

    return rows.select(*keys, "y", _let(given, blended).alias("cells"))


def texture(points: DataFrame, keys: list[str], lon: str, lat: str, value: str, seq: str) -> DataFrame:
    """Points to the finished grid: rasterise, fill short gaps, blur twice, smooth the poles."""
    return reduce(
        lambda rows, step: step(rows, keys),
        [fill_rows, blur, polar_smooth],
        rasterise(points, keys, lon, lat, value, seq),
    )
