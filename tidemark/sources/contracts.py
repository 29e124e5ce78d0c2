"""Feed contracts: drift reports and the choice between a primary and a fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import REQUIRED


class ContractError(ValueError):
    """A landed feed lacks data or columns that the jobs need."""


def check_contract(feed: str, df: DataFrame, required: dict[str, list[str]] = REQUIRED) -> DataFrame:
    """The frame itself, or an error naming the missing and the received columns."""
    missing = sorted(set(required[feed]) - set(df.columns))
    if missing:
        raise ContractError(f"{feed}: missing {missing}, received {sorted(df.columns)}")
    if df.isEmpty():
        raise ContractError(f"{feed}: empty data")
    return df


def schema_drift(payloads: DataFrame, feed: str, payload: str, required: DataFrame) -> DataFrame:
    """(feed, missing_col) for required columns that no record of the feed's payloads carries.

    `required` has (feed, col). Every record counts, not only the first one.
    """
    records = payloads.select(F.col(feed).alias("feed"), F.explode(F.from_json(payload, "array<map<string,string>>")).alias("_r"))
    seen = records.select("feed", F.explode(F.map_keys("_r")).alias("col")).distinct()
    return required.join(seen, ["feed", "col"], "left_anti").select("feed", F.col("col").alias("missing_col"))


def choose_feed(candidates: DataFrame, feed: str = "feed", rank: str = "rank", valid: str = "valid") -> DataFrame:
    """Best valid candidate per feed: (feed, chosen, failed); a feed without one is marked failed."""
    best = F.min_by("path", F.when(F.col(valid), F.col(rank)))
    return candidates.groupBy(feed).agg(best.alias("chosen")).withColumn("failed", F.col("chosen").isNull())


def first_valid(feed: str, candidates: list[DataFrame]) -> DataFrame | None:
    """First candidate that passes its contract; None marks the feed as failed for this run."""
    for df in candidates:
        try:
            return check_contract(feed, df)
        except ContractError:
            continue
    return None
