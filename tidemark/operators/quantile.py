"""Exact quantiles without a per-key value map.

Every value falls into a bin of a fixed monotone scale, and into one of 2**20 finer bins inside it.
Counts, combined map-side, locate the bin that holds the wanted rank, then the fine bin; only the
distinct values of that fine bin are ranked one by one. Repeated values collapse into one counted
row before any exchange, so neither a hot key, nor a hot value, nor a narrow column is gathered in
one task: a window sees the bins of a column, or the fine bins of a bin, or the distinct values
within a relative width of 2**-30.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS_PER_UNIT = 1 << 10
FINE_PER_UNIT = 1 << 30  # a multiple of the above by a power of two, so fine bins never straddle


def _bin(value: str, per_unit: int = BINS_PER_UNIT) -> str:
    """A monotone whole-number scale: fine near zero, logarithmic further out."""
    size = f"CAST(floor(log1p(abs({value})) * {per_unit}) AS BIGINT)"
    return f"CASE WHEN {value} < 0 THEN -{size} - 1 ELSE {size} END"


def _long(df: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """(keys, _col, _x) for every non-NULL value; negative zero counts as zero."""
    pairs = ", ".join(f"struct('{c}' AS _col, CAST({e} AS DOUBLE) + 0.0D AS _x)" for c, e in values.items())
    return df.selectExpr(*_names(keys), f"inline(array({pairs}))").where("_x IS NOT NULL")


def _names(cols: list[str]) -> list[str]:
    return [f"`{c}`" for c in cols]


def _targets(by_bin: DataFrame, group: list[str], q: float) -> DataFrame:
    """The one or two bins per group that hold the ranks on both sides of the quantile."""
    part = f"PARTITION BY {', '.join(_names(group))}"
    ranked = by_bin.selectExpr(
        "*",
        f"sum(_n) OVER ({part} ORDER BY _bin ROWS UNBOUNDED PRECEDING) AS _upto",
        f"sum(_n) OVER ({part}) AS _all",
    )
    at = f"(_all - 1) * {float(q)!r}D"
    placed = ranked.selectExpr(
        *_names(group), "_bin", "_upto", "_upto - _n AS _below", "_all", f"CAST(floor({at}) AS BIGINT) AS _low", f"{at} - floor({at}) AS _t"
    ).selectExpr("*", "least(_low + 1, _all - 1) AS _high")
    holds = " OR ".join(f"(_below <= {r} AND {r} < _upto)" for r in ("_low", "_high"))
    return placed.where(holds).drop("_upto", "_all")


def quantile_long(
    df: DataFrame, keys: list[str], cols: list[str], q: float, spine: DataFrame | None = None
) -> DataFrame:
    """(keys, _col, _q): the q-quantile of each column, linearly interpolated, NULLs ignored.

    `spine` lists the distinct (key, bucket) pairs of a frame that is clustered by them: the wanted
    bins then reach the rows over those pairs instead of over the key alone.
    """
    group = [*keys, "_col"]
    if keys and spine is None:
        counted = _long(df, keys, {c: f"`{c}`" for c in cols}).groupBy(*group, "_x").agg(F.count("*").alias("_n"))
        counted = counted.selectExpr("*", f"{_bin('_x')} AS _bin")
        targets = _targets(counted.groupBy(*group, "_bin").agg(F.sum("_n").alias("_n")), group, q)
    else:
        binned = _long(df, keys, {c: f"`{c}`" for c in cols}).selectExpr(*_names(group), f"{_bin('_x')} AS _bin")
        targets = _targets(binned.groupBy(*group, "_bin").agg(F.count("*").alias("_n")), group, q)
        edges = targets.groupBy(*keys).agg(
            *[F.expr(f"{f}(CASE WHEN _col = '{c}' THEN _bin END) AS `_{f}_{c}`") for c in cols for f in ("min", "max")]
        )
        if keys:
            near = df.join(spine.join(edges, keys), spine.columns)
        else:
            row = edges.select(F.struct("*")).scalar()
            near = df.withColumn("_e", row).selectExpr("*", "_e.*")
        # No bin between the two wanted ones is occupied.
        inside = {c: f"CASE WHEN {_bin(f'`{c}`')} BETWEEN `_min_{c}` AND `_max_{c}` THEN `{c}` END" for c in cols}
        counted = _long(near, keys, inside).groupBy(*group, "_x").agg(F.count("*").alias("_n"))
        counted = counted.selectExpr("*", f"{_bin('_x')} AS _bin")
    return resolve(counted, targets, group)


def resolve(counted: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """(group, _q) from the counted distinct values (`_x`, `_n`, `_bin`) of the wanted bins."""
    near_rank = counted.join(targets, [*group, "_bin"]).selectExpr("*", f"{_bin('_x', FINE_PER_UNIT)} AS _fine")
    fine = [*group, "_bin", "_fine"]
    part = ", ".join(_names([*group, "_bin"]))
    placed = near_rank.groupBy(*fine, "_below", "_low", "_high").agg(F.sum("_n").alias("_m")).selectExpr(
        "*", f"_below + sum(_m) OVER (PARTITION BY {part} ORDER BY _fine ROWS UNBOUNDED PRECEDING) AS _end"
    )
    within = " OR ".join(f"(_end - _m <= {r} AND {r} < _end)" for r in ("_low", "_high"))
    wanted = placed.where(within).selectExpr(*_names(fine), "_end - _m AS _under")
    part = ", ".join(_names(fine))
    hits = near_rank.join(wanted, fine).drop("_below").withColumnRenamed("_under", "_below").selectExpr(
        "*", f"_below + sum(_n) OVER (PARTITION BY {part} ORDER BY _x ROWS UNBOUNDED PRECEDING) AS _upto"
    )
    at = lambda r: f"max(CASE WHEN _upto - _n <= {r} AND {r} < _upto THEN _x END)"
    ends = hits.groupBy(*group).agg(F.expr(f"{at('_low')} AS _a"), F.expr(f"{at('_high')} AS _b"), F.max("_t").alias("_t"))
    # Interpolated from the nearer end, as array libraries do.
    value = "CASE WHEN _t >= 0.5D THEN _b - (_b - _a) * (1 - _t) ELSE _a + (_b - _a) * _t END AS _q"
    return ends.selectExpr(*_names(group), value)


def quantiles(
    df: DataFrame,
    keys: list[str],
    cols: list[str],
    q: float = 0.97,
    approx: bool = False,
    spine: DataFrame | None = None,
) -> DataFrame:
    """One row per key with the q-quantile of each column under the column's name."""
    if approx:
        return df.groupBy(*keys).agg(*[F.percentile_approx(c, q, 10000).alias(c) for c in cols])
    tall = quantile_long(df, keys, cols, q, spine)
    return tall.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN _col = '{c}' THEN _q END) AS `{c}`") for c in cols])
