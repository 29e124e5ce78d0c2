"""Payload formats and feed contracts, on documents that Spark builds from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeparts import floor_time
from ..operators.merge import land, land_documents
from ..plans.jobs import land_feeds
from ..session import shared_folder
from ..sources.contracts import choose_feed, schema_drift
from ..sources.fixed_width import hourly_records
from ..sources.payloads import (
    after_marker,
    dict_rows,
    grid_rows,
    list_rows,
    nested_samples,
    parallel_rows,
    payload_rejects,
    payload_rows,
    read_dicts,
    read_documents,
    rename_mirror,
    sniff,
)
from ..sources.tables import read_legacy, read_or_empty
from . import adapters as A
from .registry import query

BATCH = 100
FIELDS = {"event_id": "bigint", "time_tag": "string", "value": "double"}


def _records(spark, sf):
    """Events in fetches of at most BATCH records per type."""
    ev = A.table(spark, sf, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return ev.select(
        "event_type", F.floor(F.col("event_id") / BATCH).alias("batch"), "event_id", stamp.alias("time_tag"), "value"
    )


def _dicts(spark, sf):
    rows = _records(spark, sf).groupBy("event_type", "batch")
    records = F.sort_array(F.collect_list(F.struct("event_id", "time_tag", "value")))
    return rows.agg(F.to_json(records).alias("payload"))


def _lists(spark, sf):
    rows = _records(spark, sf).groupBy("event_type", "batch")
    record = F.array(F.col("event_id").cast("string"), F.col("time_tag"), F.col("value").cast("string"))
    header = F.array(F.array(F.lit("event_id"), F.lit("time_tag"), F.lit("value")))
    return rows.agg(F.to_json(F.concat(header, F.sort_array(F.collect_list(record)))).alias("payload"))


_STAMPED = "SELECT event_type, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time_tag, value FROM events"


@query("json_dicts", _STAMPED)
def json_dicts(spark, sf):
    return dict_rows(_dicts(spark, sf), "payload", FIELDS, ["event_type"]).drop("seq")


@query("json_lists", _STAMPED)
def json_lists(spark, sf):
    return list_rows(_lists(spark, sf), "payload", FIELDS, ["event_type"]).drop("seq")


@query("json_sniff", _STAMPED)
def json_sniff(spark, sf):
    """Both array forms in one archive; each document is routed by its own form."""
    as_list = F.col("event_type").isin("view", "click")
    archive = _lists(spark, sf).where(as_list).unionByName(_dicts(spark, sf).where(~as_list))
    return payload_rows(archive, "payload", FIELDS, ["event_type"]).drop("seq")


@query(
    "json_formats",
    """SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 'list_of_lists' ELSE 'list_of_dicts' END AS format,
  count(DISTINCT event_id // 100) AS documents FROM events GROUP BY event_type""",
)
def json_formats(spark, sf):
    as_list = F.col("event_type").isin("view", "click")
    archive = _lists(spark, sf).where(as_list).unionByName(_dicts(spark, sf).where(~as_list))
    return archive.groupBy("event_type", sniff(F.col("payload")).alias("format")).agg(F.count("*").alias("documents"))


@query("json_files", _STAMPED.replace("event_type, ", ""))
def json_files(spark, sf):
    """The dict documents as gzip files in the shared folder, one array in each, read back as files."""
    path = shared_folder(spark, "json")
    records = F.sort_array(F.collect_list(F.struct("event_id", "time_tag", "value")))
    # A file is one fetch: events of at most 1,000 numbers.
    docs = _records(spark, sf).groupBy(F.floor(F.col("event_id") / 1000).alias("file")).agg(F.to_json(records).alias("payload"))
    docs.write.option("compression", "gzip").partitionBy("file").text(path)
    schema = ", ".join(f"{n} {t}" for n, t in FIELDS.items())
    return read_dicts(spark, f"{path}/file=*", schema)


def _damaged(spark, sf):
    """The dict documents of the events, some cut short and some in no known form."""
    docs = _dicts(spark, sf)
    kind = F.pmod("batch", F.lit(7))
    cut = F.when(kind == 1, F.expr("substring(payload, 1, length(payload) - 1)")).when(kind == 2, F.concat(F.lit("{"), F.col("payload"), F.lit("}")))
    return docs.withColumn("payload", F.coalesce(cut, "payload"))


@query(
    "payload_rejects",
    """SELECT DISTINCT event_type, event_id // 100 AS batch, CASE WHEN event_id // 100 % 7 = 1 THEN 'malformed' ELSE 'unknown form' END AS reason
FROM events WHERE event_id // 100 % 7 IN (1, 2)""",
)
def rejects(spark, sf):
    return payload_rejects(_damaged(spark, sf), "payload", ["event_type", "batch"])


@query(
    "landing_last_document_wins",
    """SELECT strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS time_tag, max(o_totalprice) AS price FROM orders GROUP BY 1""",
)
def last_document(spark, sf):
    """Two overlapping fetches of the daily peaks: the first has half of each, in the opposite order."""
    root = shared_folder(spark, "documents")
    days = A.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00").alias("time_tag"), floor_time(F.col("o_orderdate"), "year").alias("y"))
    peaks = days.agg(F.max("o_totalprice").alias("price"))
    for name, factor, ascending in (("1", 0.5, False), ("2", 1.0, True)):
        record = F.sort_array(F.collect_list(F.struct("time_tag", (F.col("price") * factor).alias("price"))), ascending)
        # A year of days in a document.
        docs = peaks.groupBy("y").agg(F.to_json(record).alias("payload")).select("payload")
        docs.repartition(F.xxhash64("payload")).write.mode("append").option("maxRecordsPerFile", 1).text(f"{root}/{name}")
    docs = read_documents(spark, f"{root}/*")
    land_documents(spark, f"{root}-raw", docs, "payload", {"time_tag": "string", "price": "double"}, ["time_tag"], "time_tag", True)
    return spark.read.parquet(f"{root}-raw/dicts").select("time_tag", "price")


def _deliveries(spark, sf):
    """Daily peaks of the orders as documents of a feed, landed in three deliveries; the raw folder.

    The first has the days to June, halved; the second the others, and a cut document a year; the
    third corrects the first. A run without anything new follows each.
    """
    root = shared_folder(spark, "deliveries")
    day = F.col("o_orderdate")
    peaks = A.table(spark, sf, "orders").groupBy(F.date_format(day, "yyyy-MM-dd'T'00:00:00").alias("time_tag"), floor_time(day, "year").alias("y"), (F.month(day) <= 6).alias("early")).agg(
        F.max("o_totalprice").alias("price")
    )
    for number, rows, factor, cut in ((1, peaks.where("early"), 0.5, False), (2, peaks.where("NOT early"), 1.0, True), (3, peaks.where("early"), 1.0, False)):
        record = F.sort_array(F.collect_list(F.struct("time_tag", (F.col("price") * factor).alias("Kp"))))
        # Half a year of days in a document.
        docs = rows.groupBy("y").agg(F.to_json(record).alias("payload")).select(F.explode(F.array("payload", F.substring("payload", 1, 30)) if cut else F.array("payload")).alias("payload"))
        docs.repartition(F.xxhash64("payload")).write.mode("append").option("maxRecordsPerFile", 1).text(f"{root}/in/kp/primary")
        for hour in ("00", "12"):
            land_feeds(spark, f"{root}/in", f"{root}/raw", F.lit(f"2024-01-0{number} {hour}:00:00").cast("timestamp_ntz"))
    return f"{root}/raw"


@query("landing_incremental", """SELECT strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS time_tag, max(o_totalprice) AS "Kp" FROM orders GROUP BY 1""")
def incremental(spark, sf):
    """Three deliveries, one of them corrected late; each document is read once."""
    return spark.read.parquet(f"{_deliveries(spark, sf)}/kp").select("time_tag", "Kp")


@query(
    "fetch_counts_observed",
    """WITH d AS (SELECT DISTINCT o_orderdate AS day, year(o_orderdate) AS y, month(o_orderdate) <= 6 AS early FROM orders),
c AS (SELECT early, count(DISTINCT y) AS files, count(*) AS records, max(day)::TIMESTAMP AS latest FROM d GROUP BY early)
SELECT n AS delivery, (files * CASE WHEN early THEN 1 ELSE 2 END)::BIGINT AS documents, (CASE WHEN early THEN 0 ELSE files END)::BIGINT AS refused, records, latest
FROM c JOIN (VALUES (1, true), (2, false), (3, true)) r(n, e) ON e = early""",
)
def counts_observed(spark, sf):
    """What each delivery's landing counted while it wrote; runs that find nothing new log nothing."""
    log = spark.read.parquet(f"{_deliveries(spark, sf)}/fetch_log").where("feed = 'kp'")
    return log.select(F.dayofmonth("at").alias("delivery"), "documents", "refused", "records", "latest")


@query("legacy_skip", "SELECT 'full' AS run, count(*) AS \"rows\" FROM orders UNION ALL SELECT 'recent', 0")
def legacy_skip(spark, sf):
    """A legacy table is read by a full run and by no other."""
    path, schema = f"{sf}/orders.parquet", A.table(spark, sf, "orders").schema
    runs = {"full": read_legacy(spark, path, schema, False), "recent": read_legacy(spark, path, schema, True)}
    out = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("run"), "rows") for n, df in runs.items()]
    return out[0].unionByName(out[1])


@query("missing_table", "SELECT 'there' AS \"table\", count(*) AS \"rows\" FROM orders UNION ALL SELECT 'missing', 0")
def missing_table(spark, sf):
    schema = A.table(spark, sf, "orders").schema
    tables = {"there": f"{sf}/orders.parquet", "missing": f"{shared_folder(spark, 'none')}/orders"}
    out = [read_or_empty(spark, p, schema).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, p in tables.items()]
    return out[0].unionByName(out[1])


@query("list_merge", _STAMPED)
def list_merge(spark, sf):
    """Header-row lists landed as they are, by their form."""
    root = shared_folder(spark, "lists")
    docs = _lists(spark, sf)
    land_documents(spark, root, docs, "payload", FIELDS, ["event_id"], "time_tag", False)
    kinds = A.table(spark, sf, "events").select("event_id", "event_type")
    return spark.read.parquet(f"{root}/lists").join(kinds, "event_id").select("event_type", *FIELDS)


@query("parallel_arrays", "SELECT event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time_tag, value AS Kp FROM events")
def parallel_arrays(spark, sf):
    rows = F.sort_array(F.collect_list(F.struct("event_id", "time_tag", "value")))
    docs = _records(spark, sf).groupBy("event_type", "batch").agg(rows.alias("r"))
    stamps = F.transform("r", lambda x: F.concat(x["time_tag"], F.lit("Z"))).alias("datetime")
    docs = docs.select("event_type", F.to_json(F.struct(stamps, F.col("r.value").alias("Kp"))).alias("payload"))
    return parallel_rows(docs, "payload", "datetime", "Kp", ["event_type"])


@query(
    "nested_samples",
    """SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' AS Obsdate, max(o_totalprice) AS swpc_ssn
FROM orders GROUP BY ALL""",
)
def nested(spark, sf):
    days = A.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderdate").agg(F.max("o_totalprice").alias("ssn"))
    sample = F.struct(F.date_format("o_orderdate", "yyyy MM dd").alias("time"), "ssn")
    # At most 31 samples per document.
    docs = days.groupBy("o_orderstatus", floor_time(F.col("o_orderdate"), "month").alias("m")).agg(
        F.sort_array(F.collect_list(sample)).alias("samples")
    )
    payload = F.to_json(F.struct(F.struct("samples").alias("international_sunspot_number")))
    return nested_samples(docs.select("o_orderstatus", payload.alias("payload")), "payload", keep=["o_orderstatus"])


@query(
    "mirror_rename",
    """SELECT strftime(o_orderdate, '%Y-%m') AS "time-tag", max(o_totalprice) AS predicted_ssn FROM orders GROUP BY 1""",
)
def mirror(spark, sf):
    rows = A.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("time_tag"))
    return rename_mirror(rows.agg(F.max("o_totalprice").alias("smoothed_ssn")))


@query(
    "grid_payload",
    """SELECT vec_id, 'f' || label AS forecast_time, 'o' || label AS observation_time, (i - 1)::INTEGER AS seq,
  (i - 1)::DOUBLE AS lon, (vec_id % 181 - 90)::DOUBLE AS lat, round(embedding[i]::DOUBLE, 4) AS value
FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)""",
)
def grid_payload(spark, sf):
    vectors = A.table(spark, sf, "embeddings")
    lat = (F.pmod("vec_id", F.lit(181)) - 90).cast("double")
    point = lambda v, i: F.array(i.cast("double"), lat, F.round(v.cast("double"), 4))
    doc = F.struct(
        F.concat(F.lit("o"), "label").alias("Observation Time"),
        F.concat(F.lit("f"), "label").alias("Forecast Time"),
        F.transform("embedding", point).alias("coordinates"),
    )
    rows = grid_rows(vectors.select("vec_id", F.to_json(doc).alias("payload")), "payload", ["vec_id"])
    return rows


@query(
    "fixed_width_expand",
    f"""WITH {A.EV}, h AS (SELECT event_type, date_trunc('hour', ts) AS time, max(k)::INTEGER AS x FROM ev GROUP BY ALL)
SELECT event_type, strftime(time, '%Y-%m-%dT%H:00:00') AS time_tag, -x::DOUBLE AS dst FROM h""",
)
def fixed_width(spark, sf):
    """Hourly peaks of k written as fixed-width daily records and parsed again; a peak that doesn't fit raises."""
    hour = floor_time(F.col("ts"), "hour").alias("time")
    fits = F.when(F.max("k") <= 999, F.max("k")).otherwise(F.raise_error(F.lit("reading too wide for its field")).cast("int"))
    peaks = A.events(spark, sf).groupBy("event_type", hour).agg(fits.alias("x"))
    day = floor_time(F.col("time"), "day").alias("day")
    field = F.lpad((-F.col("x")).cast("string"), 4, " ")
    # At most 24 entries per record.
    days = peaks.groupBy("event_type", day).agg(
        F.map_from_entries(F.collect_list(F.struct(F.hour("time").alias("h"), field.alias("f")))).alias("m")
    )
    fields = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", h), F.lit("9999")))
    head = F.rpad(F.concat(F.lit("DST"), F.date_format("day", "yyMM"), F.lit("*"), F.date_format("day", "dd")), 16, " ")
    line = F.concat(head, F.lit("   0"), F.array_join(fields, ""), F.lit("   1"))
    return hourly_records(days.select("event_type", line.alias("value")), "value", ["event_type"])


@query(
    "schema_drift",
    """WITH required AS (SELECT t.event_type AS feed, c.col FROM (SELECT DISTINCT event_type FROM events) t,
   (VALUES ('k'), ('unit')) c(col)), seen AS (SELECT DISTINCT event_type AS feed, unnest(json_keys(props)) AS col FROM events)
SELECT r.feed, r.col AS missing_col FROM required r ANTI JOIN seen s ON r.feed = s.feed AND r.col = s.col""",
)
def drift(spark, sf):
    ev = A.table(spark, sf, "events")
    docs = ev.select(F.col("event_type").alias("feed"), F.concat(F.lit("["), "props", F.lit("]")).alias("payload"))
    required = ev.select(F.col("event_type").alias("feed")).distinct()
    required = required.select("feed", F.explode(F.array(F.lit("k"), F.lit("unit"))).alias("col"))
    return schema_drift(docs, "feed", "payload", required)


@query(
    "fallback_choice",
    """WITH c AS (SELECT lang AS feed, source AS path, replace(source, 'src', '')::INTEGER AS rank, max(n_chars) < 20000 AS valid
  FROM documents GROUP BY lang, source)
SELECT feed, arg_min(path, rank) FILTER (WHERE valid) AS chosen, count(*) FILTER (WHERE valid) = 0 AS failed FROM c GROUP BY feed""",
)
def fallback(spark, sf):
    rank = F.replace("source", F.lit("src"), F.lit("")).cast("int").alias("rank")
    candidates = (
        A.table(spark, sf, "documents")
        .groupBy(F.col("lang").alias("feed"), F.col("source").alias("path"), rank)
        .agg((F.max("n_chars") < 20000).alias("valid"))
    )
    return choose_feed(candidates)


@query(
    "marker_extract",
    r"""SELECT doc_id, coalesce(nullif(regexp_replace(list_last(string_split(text, '. ')), '^\s+|\s+$', '', 'g'), ''), 'unavailable') AS tail
FROM documents""",
)
def marker(spark, sf):
    docs = A.table(spark, sf, "documents")
    return docs.select("doc_id", after_marker(F.col("text"), ". ", "unavailable").alias("tail"))


@query(
    "merge_dispatch",
    """SELECT 'orders' AS feed, strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderdate) AS "rows" FROM orders GROUP BY 2
UNION ALL SELECT 'lineitem', 'all', count(DISTINCT l_shipdate) FROM lineitem""",
)
def dispatch(spark, sf):
    """One feed lands by month, one as a single table, a failed one not at all."""
    root = shared_folder(spark, "land")
    orders = A.table(spark, sf, "orders").select(F.col("o_orderdate").alias("time"), "o_orderkey")
    items = A.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("time"), "l_orderkey")
    land(spark, f"{root}/orders", orders, ["time"], "time", True)
    land(spark, f"{root}/lineitem", items, ["time"], "time", False)
    land(spark, f"{root}/failed", None, ["time"], "time", True)
    by_month = spark.read.parquet(f"{root}/orders").groupBy(F.col("month").cast("string").alias("month"))
    whole = spark.read.parquet(f"{root}/lineitem").agg(F.count("*").alias("rows"))
    return by_month.agg(F.count("*").alias("rows")).select(F.lit("orders").alias("feed"), "month", "rows").unionByName(
        whole.select(F.lit("lineitem").alias("feed"), F.lit("all").alias("month"), "rows")
    )
