"""Fixed-width daily records to hourly rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the record layout.
PREFIX, HEADER, FIELD, FIELDS, MISSING, CENTURY = "DST", 16, 4, 26, "9999", 2000


def hourly_records(df: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(time_tag, dst) for the 24 hourly fields of each record; missing and blank hours drop out.

    Field 0 (base value) and field 25 (daily mean) are not readings.
    """
    keep = keep or []
    text = F.col(line)
    records = df.where(text.startswith(PREFIX) & (F.length(text) >= HEADER + FIELD * FIELDS))
    number = lambda at, n: F.substring(text, at, n).cast("int")
    hours = F.transform(
        F.sequence(F.lit(1), F.lit(24)),
        lambda f: F.trim(F.substring(text, F.lit(HEADER + 1) + f * FIELD, F.lit(FIELD))),
    )
    day = F.make_date(number(4, 2) + CENTURY, number(6, 2), number(9, 2))
    rows = records.select(*keep, day.alias("_d"), F.posexplode(hours).alias("_h", "_v"))
    rows = rows.where((F.col("_v") != MISSING) & (F.col("_v") != ""))
    stamp = F.concat(F.date_format("_d", "yyyy-MM-dd"), F.lit("T"), F.lpad(F.col("_h").cast("string"), 2, "0"), F.lit(":00:00"))
    return rows.select(*keep, stamp.alias("time_tag"), F.col("_v").cast("double").alias("dst"))
