"""JSON and text payloads to rows.

Payload columns hold one fetched document per row, so an archive of any number of documents is
parsed by as many tasks as it has splits. A document that does not parse stops the job; `payload_rejects`
lists such documents beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DICTS, LISTS = "list_of_dicts", "list_of_lists"
#: Records of one document at most; places in a document stay below it.
DOCUMENT_ROWS = 1 << 31
_STRICT = {"mode": "FAILFAST"}


def read_dicts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files holding a JSON array of records (plain or gzip); unknown keys are ignored, a damaged file raises."""
    return spark.read.schema(schema).option("multiLine", True).options(**_STRICT).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(payload, document): one row per file, numbered by arrival (time written, then name).

    The numbering sorts one short row per file; no payload moves for it.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), "_metadata.file_path")
    order = Window.orderBy("file_modification_time", "file_path")
    listed = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_modification_time")
    numbers = listed.select("file_path", (F.row_number().over(order) - 1).cast("bigint").alias("document"))
    return files.join(numbers, "file_path").select("payload", "document")


def arrival(document: str = "document", seq: str = "seq") -> Column:
    """One whole number that orders records by document, then by place in it."""
    return F.col(document) * DOCUMENT_ROWS + F.col(seq)


def payload_rejects(df: DataFrame, payload: str, keep: list[str] | None = None) -> DataFrame:
    """(keep, reason) of documents in neither array form, or that do not parse in their form."""
    form = sniff(F.col(payload))
    records = F.from_json(payload, "array<map<string,string>>")
    lists = F.from_json(payload, "array<array<string>>")
    reason = (
        F.when(F.col(payload).isNull() | form.isNull(), "unknown form")
        .when((form == DICTS) & records.isNull(), "malformed")
        .when((form == LISTS) & lists.isNull(), "malformed")
    )
    return df.select(*(keep or []), reason.alias("reason")).where(F.col("reason").isNotNull())


def _parsed(payload: str, schema: str) -> Column:
    """The payload under a schema; a document that does not fit it, or is missing, raises."""
    bad = F.raise_error(F.concat(F.lit("malformed payload: "), F.coalesce(F.substring(payload, 1, 40), F.lit("NULL"))))
    return F.coalesce(F.from_json(payload, schema, _STRICT), bad.cast(schema))


def _given(value: Column, what: str) -> Column:
    """The value, or an error naming what a document lacks."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"malformed payload: no {what}")))


def sniff(payload: Column) -> Column:
    """Which array form a payload has, from its first element; NULL if neither."""
    return (
        F.when(F.regexp_like(payload, F.lit(r"^\s*\[\s*\[")), LISTS)
        .when(F.regexp_like(payload, F.lit(r"^\s*\[\s*\{")), DICTS)
    )


def with_records(df: DataFrame, payload: str, out: str) -> DataFrame:
    """`df` with `out`, the records of either array form as maps of texts, instead of the payload.

    NULL for a document that is neither or does not parse; `{out}_form` is its form. Each document
    is parsed once.
    """
    rest = [c for c in df.columns if c != payload]
    form = sniff(F.col(payload))
    parsed = df.select(
        *rest,
        form.alias(f"{out}_form"),
        F.when(form == DICTS, F.from_json(payload, "array<map<string,string>>")).alias("_d"),
        F.when(form == LISTS, F.from_json(payload, "array<array<string>>")).alias("_l"),
    )
    named = parsed.select("*", F.get("_l", F.lit(0)).alias("_h"), F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))).alias("_v"))
    entry = lambda r: F.map_from_entries(F.filter(F.arrays_zip(F.col("_h").alias("k"), r.alias("v")), lambda e: e["k"].isNotNull()))
    return named.select(*rest, f"{out}_form", F.coalesce("_d", F.transform("_v", entry)).alias(out))


def dict_rows(df: DataFrame, payload: str, fields: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """A row per record; `seq` is the record's place in its payload."""
    schema = "array<struct<" + ",".join(f"`{n}`:{t}" for n, t in fields.items()) + ">>"
    keep = keep or []
    rows = df.select(*keep, F.posexplode(_parsed(payload, schema)).alias("seq", "_r"))
    return rows.select(*keep, "seq", *[F.col(f"_r.`{n}`").alias(n) for n in fields])


def list_rows(df: DataFrame, payload: str, fields: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """A row per list after the header list, columns found by header name; absent ones are NULL."""
    keep = keep or []
    table = df.select(*keep, _parsed(payload, "array<array<string>>").alias("_a"))
    table = table.select(
        *keep, F.get("_a", F.lit(0)).alias("_h"), F.posexplode(F.slice("_a", F.lit(2), F.greatest(F.size("_a") - 1, F.lit(0)))).alias("seq", "_r")
    )
    pick = lambda n: F.get("_r", (F.array_position("_h", n) - 1).cast("int"))
    return table.select(*keep, "seq", *[pick(n).cast(t).alias(n) for n, t in fields.items()])


def seen_columns(df: DataFrame, payload: str) -> DataFrame:
    """(col): every key of every record, or every header name, with repeats."""
    marked = df.withColumn("_f", sniff(F.col(payload)))
    records = marked.where(F.col("_f") == DICTS).select(F.explode(F.from_json(payload, "array<map<string,string>>")).alias("_r"))
    headers = marked.where(F.col("_f") == LISTS).select(F.get(F.from_json(payload, "array<array<string>>"), F.lit(0)).alias("_h"))
    return records.select(F.explode(F.map_keys("_r")).alias("col")).unionByName(headers.select(F.explode("_h").alias("col")))


def payload_rows(df: DataFrame, payload: str, fields: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Either array form; any other payload stops the job."""
    unknown = F.raise_error(F.concat(F.lit("unknown payload format: "), F.substring(payload, 1, 40)))
    marked = df.withColumn("_f", F.coalesce(sniff(F.col(payload)), unknown.cast("string")))
    dicts = dict_rows(marked.where(F.col("_f") == DICTS), payload, fields, keep)
    lists = list_rows(marked.where(F.col("_f") == LISTS), payload, fields, keep)
    return dicts.unionByName(lists)


def parallel_rows(df: DataFrame, payload: str, time: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """{"datetime": [...], "<value>": [...]} to (time_tag, value) rows."""
    schema = f"struct<`{time}`:array<string>,`{value}`:array<double>>"
    keep = keep or []
    times, values = _given(F.col(f"_p.`{time}`"), time), _given(F.col(f"_p.`{value}`"), value)
    even = F.when(F.size(times) == F.size(values), times).otherwise(F.raise_error(F.lit("malformed payload: arrays of unequal length")))
    pairs = F.inline(F.arrays_zip(even.alias("t"), values.alias("v")))
    rows = df.select(*keep, _parsed(payload, schema).alias("_p")).select(*keep, pairs.alias("t", "v"))
    return rows.select(*keep, F.rtrim("t", F.lit("Z")).alias("time_tag"), F.col("v").alias(value))


def nested_samples(
    df: DataFrame, payload: str, root: str = "international_sunspot_number", keep: list[str] | None = None
) -> DataFrame:
    """{root: {"samples": [{"time": "Y M D", "ssn": n}]}} to (Obsdate, swpc_ssn) rows."""
    schema = f"struct<`{root}`:struct<samples:array<struct<time:string,ssn:double>>>>"
    keep = keep or []
    rows = df.select(*keep, F.inline(_given(_parsed(payload, schema).getField(root).getField("samples"), "samples")))
    day = F.concat(F.replace("time", F.lit(" "), F.lit("-")), F.lit("T00:00:00"))
    return rows.select(*keep, day.alias("Obsdate"), F.col("ssn").alias("swpc_ssn"))


def rename_mirror(df: DataFrame) -> DataFrame:
    """The mirror's field names to the primary feed's."""
    return df.withColumnsRenamed({"time_tag": "time-tag", "smoothed_ssn": "predicted_ssn"})


def grid_rows(df: DataFrame, payload: str, keep: list[str] | None = None) -> DataFrame:
    """Grid payload to (observation_time, forecast_time, seq, lon, lat, value) rows."""
    schema = "struct<`Observation Time`:string,`Forecast Time`:string,coordinates:array<array<double>>>"
    keep = keep or []
    grid = df.select(*keep, _parsed(payload, schema).alias("g"))
    points = grid.select(
        *keep,
        F.col("g.`Observation Time`").alias("observation_time"),
        F.col("g.`Forecast Time`").alias("forecast_time"),
        F.posexplode(_given(F.col("g.coordinates"), "coordinates")).alias("seq", "_c"),
    )
    return points.select(*points.columns[:-1], *[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(("lon", "lat", "value"))])


def after_marker(text: Column, marker: str, placeholder: str) -> Column:
    """Trimmed text after the last marker (all of it without one); a placeholder if blank."""
    tail = F.regexp_replace(F.substring_index(text, marker, -1), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(tail, F.lit("")), F.lit(placeholder))
