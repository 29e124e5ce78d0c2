"""Rounding, unit conversion and the fixed physical constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PROTON_MASS_KG = 1.6726e-27
FEATURE_STATS = {  # column: (median, inter-quartile range)
    "speed": (410.43, 128.55),
    "temperature": (76430.0, 107250.0),
    "density": (3.19466, 3.8),
    "bz": (-0.01, 3.72),
    "bx": (-0.6, 5.39),
    "by": (-0.02, 4.98),
    "pressure": (573059.4476, 695837.1271),
    "predicted_ssn": (57.9, 86.3),
}
TARGET_OFFSET, TARGET_SCALE = -8, 19


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Array-style rounding: scale, round half to even, unscale."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def round_mean(x: Column, digits: int = 2, half_up: bool = False) -> Column:
    """Rounds an average the same way whatever order its values were added in.

    The summation noise is rounded off first, so a tie is a tie on every run.
    """
    scale = float(10**digits)
    steady = F.round(x * scale, 6)
    return (F.floor(steady + 0.5) if half_up else F.rint(steady)) / scale


def dynamic_pressure(density: Column, speed: Column) -> Column:
    """Proton dynamic pressure in nPa from particles per cm3 and km/s."""
    return F.lit(PROTON_MASS_KG) * density * 1e6 * (speed * speed) * 1e6 * 1e9


def normalise(column: str, stats: dict = FEATURE_STATS) -> Column:
    median, spread = stats[column]
    return (F.col(column) - F.lit(float(median))) / F.lit(float(spread))


def denormalise(prediction: Column, offset: float = TARGET_OFFSET, scale: float = TARGET_SCALE) -> Column:
    return prediction * F.lit(float(scale)) + F.lit(float(offset))


def positive_only(x: Column) -> Column:
    """A physical quantity that cannot be zero or below is missing there."""
    return F.when(x > 0, x)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def wrap_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.when(lon <= 180, lon).otherwise(lon - 360)


def unit_scale(x: Column, factor: float) -> Column:
    return x / F.lit(float(factor))


def lookup(mapping: dict[str, int], key: Column, default: int) -> Column:
    """Value of a small fixed map, with a default for unknown keys."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))
