"""Fetched documents of each feed, in a primary and a fallback form, as validated rows.

Documents lie in {landing}/{feed}/{primary|fallback}/; a fetcher outside Spark puts them there. A run
reads those that came since the last one (see `ledger`), each once.
"""

from __future__ import annotations

import dataclasses
import datetime
import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import parse_time
from ..schemas import MAG_COLS, PLASMA_COLS, RAW_KEYS, REQUIRED
from ..session import staged
from .fixed_width import hourly_records
from .ledger import LANDED, PASSED, REFUSED, pending, read_pending
from .payloads import arrival, nested_samples, parallel_rows, with_records

_SOURCED = {"time_tag": "string", "active": "boolean", "source": "string"}
FIELDS = {
    "mag": {**_SOURCED, **{c: "double" for c in MAG_COLS}},
    "plasma": {**_SOURCED, **{c: "double" for c in PLASMA_COLS}},
    "dst": {"time_tag": "string", "dst": "double"},
    "kp": {"time_tag": "string", "Kp": "double"},
    "ssn": {"Obsdate": "string", "swpc_ssn": "double"},
    "smoothed_ssn": {"time-tag": "string", "predicted_ssn": "double"},
}


@dataclasses.dataclass
class Delivery:
    """What came of a feed's new documents: rows to land, an entry for each document, and counts."""

    rows: DataFrame | None = None
    entries: list[tuple[Row, str, str | None]] = dataclasses.field(default_factory=list)
    refused: list[tuple[str, str]] = dataclasses.field(default_factory=list)
    documents: int = 0
    records: int = 0
    latest: datetime.datetime | None = None


def _records(docs: DataFrame, fields: dict[str, str], required: list[str]) -> tuple[DataFrame, Observation]:
    """Records of JSON documents with what is wrong with each, and an observation of the whole.

    `_bad` says why a document must be refused: its form, or a text that is no value. The
    observation counts documents and tells which required columns any record carries.
    """
    rows = with_records(docs, "payload", "_m").select("document", "written", "_m_form", F.col("_m").isNull().alias("_none"), F.posexplode_outer("_m").alias("seq", "_r"))
    broken = F.when(F.col("_m_form").isNull(), "unknown form").when(F.col("_none"), "malformed")
    named = rows.select("document", "written", "seq", "_r", broken.alias("_bad"), *[F.col("_r").getItem(c).alias(f"_t{i}") for i, c in enumerate(fields)])
    seen = Observation()
    carried = [F.coalesce(F.bool_or(F.map_contains_key("_r", c)), F.lit(False)).alias(f"has_{i}") for i, c in enumerate(required)]
    named = named.observe(seen, F.count_if(F.coalesce("seq", F.lit(0)) == 0).alias("documents"), *carried)
    typed = [F.col(f"_t{i}").try_cast(t).alias(c) for i, (c, t) in enumerate(fields.items())]
    wrong = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull() & F.col(f"_t{i}").try_cast(t).isNull(), f"no {t}: {c}") for i, (c, t) in enumerate(fields.items())])
    return named.select("document", "written", "seq", F.coalesce("_bad", wrong).alias("_bad"), *typed), seen


def in_arrival(rows: DataFrame) -> DataFrame:
    """`seq` counts on over documents, so that a later document's record beats an earlier one's."""
    return rows.withColumn("seq", arrival()).drop("document")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of forms that have at most one record for each time in a document."""
    return rows.withColumn("seq", F.lit(0).cast("bigint"))


def _lines(docs: DataFrame) -> DataFrame:
    """(document, written, seq, value): the lines of all documents."""
    return docs.select("document", "written", F.posexplode(F.split("payload", r"\r?\n")).alias("seq", "value"))


KEPT = ["document", "written"]
#: Feeds whose fallback has a form of its own: a whole document of it is right, or the form is refused.
FORMS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dst": lambda docs: hourly_records(_lines(docs), keep=[*KEPT, "seq"]),
    "kp": lambda docs: _placed(parallel_rows(docs, "payload", "datetime", "Kp", KEPT)),
    "ssn": lambda docs: _placed(nested_samples(docs, "payload", keep=KEPT)),
}
#: Feeds whose mirror names its columns otherwise: the mirror's name of each column.
MIRRORS = {"smoothed_ssn": {"time-tag": "time_tag", "predicted_ssn": "smoothed_ssn"}}


def _parsed(docs: DataFrame, feed: str, kind: str) -> tuple[DataFrame, Observation | None, list[str]]:
    """Records of one form under the feed's own column names, each with its faults."""
    if kind == "fallback" and feed in FORMS:
        rows = FORMS[feed](docs)
        return rows.select(*KEPT, "seq", F.lit(None).cast("string").alias("_bad"), *[F.col(f"`{c}`") for c in FIELDS[feed]]), None, []
    names = MIRRORS.get(feed, {}) if kind == "fallback" else {}
    fields = {names.get(c, c): t for c, t in FIELDS[feed].items()}
    required = [names.get(c, c) for c in REQUIRED[feed]]
    rows, seen = _records(docs, fields, required)
    return rows.withColumnsRenamed({v: k for k, v in names.items()}), seen, required


def _take(spark: SparkSession, feed: str, kind: str, path: str, files: list[Row]) -> Delivery:
    """Reads new documents of one form: every one is parsed once, and what it gave is staged.

    A document with a fault is refused and the others land. Without a required column, or without
    any row, the form is refused whole.
    """
    time = RAW_KEYS[feed][0]
    rows, seen, required = _parsed(read_pending(spark, files), feed, kind)
    at = parse_time(F.col(f"`{time}`"), strict=False)
    no_time = F.when(F.col(f"`{time}`").isNotNull() & at.isNull(), f"no time: {time}")
    checked = rows.withColumn("_bad", F.coalesce("_bad", no_time)).withColumn("_at", at).withColumn("seq", arrival()).where("_bad IS NOT NULL OR _at IS NOT NULL")
    counted = Observation()
    good = F.col("_bad").isNull()
    kept = staged(checked.observe(counted, F.count_if(good).alias("records"), F.count_if(~good).alias("faults"), F.max(F.when(good, F.col("_at"))).alias("latest")), f"feed-{feed}")
    counts = counted.get
    missing = [c for i, c in enumerate(required) if seen is not None and not seen.get[f"has_{i}"]]
    out = Delivery(documents=len(files), records=counts["records"] or 0, latest=counts["latest"])
    faults: dict[int, str] = {}
    if counts["faults"]:  # at most one reason a new document
        faults = dict(kept.where(~good).groupBy("document").agg(F.min("_bad")).collect())
        kept = kept.where(~F.col("document").isin(sorted(faults)))
    if missing:
        faults = {i: faults.get(i, f"missing {missing}") for i in range(len(files))}
    elif len(faults) < len(files) and not out.records:
        faults = {i: faults.get(i, "empty data") for i in range(len(files))}
    out.entries = [(f, REFUSED if i in faults else LANDED, faults.get(i)) for i, f in enumerate(files)]
    out.refused = [(path, reason) for reason in sorted(set(faults.values()))]
    if len(faults) < len(files):
        out.rows = kept.drop("_bad", "_at", "document")
        if faults:
            out.records = out.rows.count()
    return out


#: Conditions of errors that a document's own content causes.
CONTENT = {"CAST_INVALID_INPUT", "CANNOT_PARSE_TIMESTAMP", "MALFORMED_RECORD_IN_PARSING", "USER_RAISED_EXCEPTION", "DUPLICATED_MAP_KEY", "INVALID_ARRAY_INDEX"}


def content_fault(error: Exception) -> str | None:
    """The message of the document's fault behind an error, None if something else failed."""
    cause = getattr(error, "_origin", None) or getattr(error, "java_exception", None)
    while cause is not None:
        text = cause.getMessage() or ""
        if set(re.findall(r"\[([A-Z_]+)[\].]", text)) & CONTENT:
            return text
        cause = cause.getCause()
    return None


def read_delivery(spark: SparkSession, landing: str, feed: str, ledger: str) -> Delivery:
    """The feed's documents that the ledger does not have, read once.

    The fallback's new documents land where the primary form has none or refused some; otherwise
    they are passed over. A document's fault refuses it and never stops the other feeds; any other
    error (a lost executor, a full disk) is raised.
    """
    out = Delivery()
    for kind in ("primary", "fallback"):
        path = f"{landing}/{feed}/{kind}"
        files = pending(spark, path, ledger)
        if not files:
            continue
        if kind == "fallback" and out.rows is not None and not out.refused:
            out.entries += [(f, PASSED, None) for f in files]
            continue
        try:
            took = _take(spark, feed, kind, path, files)
        except (PySparkException, Py4JJavaError) as error:
            fault = content_fault(error)
            if fault is None:
                raise
            reason = fault.strip().splitlines()[0][:300]
            took = Delivery(entries=[(f, REFUSED, reason) for f in files], refused=[(path, reason)], documents=len(files))
        out.entries += took.entries
        out.refused += took.refused
        out.documents += took.documents
        out.records += took.records
        out.latest = max((x for x in (out.latest, took.latest) if x), default=None)
        out.rows = took.rows if out.rows is None else out.rows if took.rows is None else out.rows.unionByName(_after(took.rows))
    return out


def _after(rows: DataFrame) -> DataFrame:
    """Fallback rows beside primary ones: between copies of one key the primary form wins."""
    return rows.withColumn("seq", F.col("seq") - F.lit(1 << 62))
