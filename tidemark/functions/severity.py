"""Ordered threshold scales turned into labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Worst first, label -> bound.
KP = {"extreme": 8, "severe": 7, "moderate": 5, "minor": 4}
DST = {"extreme": -200, "severe": -100, "moderate": -50, "minor": -30}
SPEED = {"severe": 600, "moderate": 500, "minor": 450}
BZ = {"severe": -20, "moderate": -10, "minor": -5}
AURORA = {"severe": 80, "moderate": 50}
KP_BANDS = [0, 4, 5, 7, 8, 9]


def classify(value: Column, bounds: dict[str, float], rising: bool = True) -> Column:
    """First label whose bound is reached; 'quiet' otherwise, NULL for a missing value."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for label, bound in bounds.items():
        out = out.when(value >= bound if rising else value <= bound, label)
    return out.otherwise("quiet")


def band(value: Column, edges: list[float] = KP_BANDS) -> Column:
    """Index of the half-open band holding `value`; the last band includes its upper edge."""
    out = F.when(value == edges[-1], F.lit(len(edges) - 2))
    for i in range(len(edges) - 1):
        out = out.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i))
    return out
