"""Raw multi-source solar wind feeds to one clean minute series per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dynamic_pressure, round_half_even
from ..operators.clean import mask_and_fill, mask_invalid, minute_boundary, project, to_double, with_time_key
from ..operators.grid import anti_append, reindex
from ..operators.thresholds import EDGE, published_thresholds, update_rates
from ..operators.select_source import SOURCE_PRIORITY, select_source
from ..schemas import MAG_COLS, MAG_NAMES, PLASMA_COLS, PLASMA_NAMES, STEP
from ..session import staged

SOLAR_COLS = ["speed", "temperature", "density", "bz", "bx", "by", "bt"]


def parse_feed(raw: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The needed columns of the on-minute records of a multi-source feed."""
    rows = project(raw, [*keys, "time_tag", "active", "source", *cols])
    return minute_boundary(with_time_key(rows, "time_tag"), "time")


def legacy_feed(raw: DataFrame, keys: list[str], cols: list[str], names: dict) -> DataFrame:
    """A frozen single-source feed under the same names."""
    rows = with_time_key(project(raw, [*keys, "time_tag", *cols]).dropDuplicates(), "time_tag")
    return rows.withColumnsRenamed(names)


def clean_solar(
    mag: DataFrame,
    plasma: DataFrame,
    old_mag: DataFrame | None = None,
    old_plasma: DataFrame | None = None,
    keys: list[str] | None = None,
    q: float = 0.97,
    thresholds: DataFrame | None = None,
    priority: dict = SOURCE_PRIORITY,
    width: str = "1 day",
    rates: str | None = None,
) -> DataFrame:
    """time, speed, temperature, density, bz, bx, by, bt, pressure: complete minutes, no NULLs
    in any column that has data at all.

    With `rates`, a folder that all runs share, the outlier thresholds cover every month that any
    run has read (see `operators.thresholds`), also if this one reads only the last two.
    """
    keys = keys or []
    raw_mag, raw_plasma = parse_feed(mag, keys, MAG_COLS), parse_feed(plasma, keys, PLASMA_COLS)
    mag = select_source(raw_mag, [*keys, "time"], MAG_COLS, priority=priority).withColumnsRenamed(MAG_NAMES)
    plasma = select_source(raw_plasma, [*keys, "time"], PLASMA_COLS, priority=priority).withColumnsRenamed(PLASMA_NAMES)
    # The first and last minute come from the raw times: no need to select sources for that.
    spans = [raw_mag.select(*keys, "time"), raw_plasma.select(*keys, "time")]
    if old_mag is not None and old_plasma is not None:
        old_mag = legacy_feed(old_mag, keys, MAG_COLS, MAG_NAMES)
        old_plasma = legacy_feed(old_plasma, keys, list(PLASMA_NAMES.values()), {})
        spans += [old_mag.select(*keys, "time"), old_plasma.select(*keys, "time")]
        mag = anti_append(old_mag, mag, keys, "time")
        plasma = anti_append(old_plasma, plasma, keys, "time")
    solar = to_double(reindex([plasma, mag], keys, "time", STEP, spans=spans), SOLAR_COLS)
    solar = mask_invalid(solar, ["density", "speed", "temperature"])
    # The repair looks at every minute several times: measure, mask, look around, fill.
    solar = staged(solar.select(*keys, "time", *SOLAR_COLS), "minutes")
    if rates is not None:
        led = update_rates(solar.sparkSession, rates, solar, keys, "time", SOLAR_COLS, width, STEP)
        thresholds = published_thresholds(solar.sparkSession, rates, keys, SOLAR_COLS, q)
        solar = mask_and_fill(led, keys, "time", SOLAR_COLS, q, width, STEP, thresholds).where(f"NOT {EDGE}").drop(EDGE)
    else:
        solar = mask_and_fill(solar, keys, "time", SOLAR_COLS, q, width, STEP, thresholds)
    solar = solar.withColumn("pressure", dynamic_pressure(F.col("density"), F.col("speed")))
    values = [*SOLAR_COLS, "pressure"]
    return solar.select(*keys, "time", *[round_half_even(F.col(c)).alias(c) for c in values])
