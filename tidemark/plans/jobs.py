"""The batch run as Spark jobs coupled only through storage, and its command line.

land:    documents -> raw tables          curate .. score: raw tables -> five frames
publish: frames -> serving tables
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cursor import run_poll
from ..operators.merge import land
from ..operators.publish import HELD_DAYS, RETENTION, change_feed
from ..operators.sequences import OnnxScorer
from ..schemas import MONTH_PARTITIONED, RAW_KEYS, SERVING
from ..session import build_session, staged, workspace
from ..sources.landing import FIELDS, in_arrival, read_delivery
from ..sources.ledger import LANDED, REFUSED, landed_feeds, pending, read_pending, record
from ..sources.payloads import grid_rows, payload_rows, read_documents
from ..sources.tables import exists, list_partitions, read_last_partitions, read_legacy, read_or_empty
from ..streaming.incremental import cadence, refresh_buckets, refresh_join, upsert_stream
from .transform import publish_all, transform

LEGACY = {
    "old_mag": "time_tag string, bz_gsm double, bx_gsm double, by_gsm double, bt double",
    "old_plasma": "time_tag string, speed double, density double, temperature double",
}


FETCH_LOG = "feed string, at timestamp_ntz, ok boolean, reason string, documents bigint, refused bigint, records bigint, latest timestamp_ntz"


def land_feeds(spark: SparkSession, landing: str, raw: str, now: Column | None = None) -> dict[str, str]:
    """Merges each feed's new documents into its raw table; feed -> 'landed' or 'failed'.

    {raw}/ledger remembers the documents, so a run reads only what came since the last one, and a
    feed with nothing new is as landed as it was. A feed that fails does not stop the run: the
    transform then uses what landed before. Every outcome is appended to {raw}/fetch_log
    (FETCH_LOG), counted while the rows are written; `fetch_counts` and `feed_silence` read it.
    """
    outcome, log, ledger = {}, [], f"{raw}/ledger"
    stamp = now if now is not None else F.localtimestamp()
    before = landed_feeds(spark, ledger)
    for feed, keys in RAW_KEYS.items():
        new = read_delivery(spark, landing, feed, ledger)
        if new.rows is not None:
            land(spark, f"{raw}/{feed}", new.rows, keys, keys[0], feed in MONTH_PARTITIONED, "seq", written="written")
        record(spark, ledger, feed, new.entries, stamp)
        there = any(exists(spark, f"{landing}/{feed}/{kind}") for kind in ("primary", "fallback"))
        outcome[feed] = "landed" if new.rows is not None or (there and not new.entries and feed in before) else "failed"
        if new.entries or outcome[feed] == "failed":
            log.append((feed, new.rows is not None, "; ".join(f"{p}: {r}" for p, r in new.refused) or None, new.documents, sum(state == REFUSED for _, state, _ in new.entries), new.records, new.latest))
    if log:
        entries = spark.createDataFrame(log, FETCH_LOG.replace("at timestamp_ntz, ", "")).withColumn("at", stamp.cast("timestamp_ntz"))
        entries = entries.select("feed", "at", "ok", "reason", "documents", "refused", "records", "latest")
        entries.coalesce(1).write.mode("append").parquet(f"{raw}/fetch_log")
    return outcome


def land_legacy(spark: SparkSession, documents: str, raw: str) -> None:
    """Header-row legacy archives, {documents}/old_mag and old_plasma, to the raw tables `read_raw` scans."""
    for name, schema in LEGACY.items():
        if exists(spark, f"{documents}/{name}"):
            fields = dict(part.split() for part in schema.split(", "))
            rows = in_arrival(payload_rows(read_documents(spark, f"{documents}/{name}"), "payload", fields, ["document"]))
            land(spark, f"{raw}/{name}", rows, ["time_tag"], "time_tag", False, "seq")


def land_grid(spark: SparkSession, documents: str, raw: str, product: str = "nowcast", now: Column | None = None) -> int:
    """Adds newly fetched grid documents to {raw}/grid with the time each was written; returns how many.

    A document lands once, as the ledger has it afterwards. One that was added by a run that stopped
    before its entry is replaced, not added again.
    """
    files = pending(spark, documents, f"{raw}/ledger")
    if not files:
        return 0
    docs = read_pending(spark, files).withColumn("retrieved_at", F.timestamp_micros("written").cast("timestamp_ntz"))
    rows = staged(grid_rows(docs, "payload", ["retrieved_at"]).withColumn("product", F.lit(product)), "grid")
    path = f"{raw}/grid"
    if exists(spark, path):
        held = spark.read.parquet(path).select("product", "retrieved_at").distinct()
        rows = rows.join(held, ["product", "retrieved_at"], "left_anti")
    rows.write.mode("append").parquet(path)
    record(spark, f"{raw}/ledger", product, [(f, LANDED, None) for f in files], now if now is not None else F.localtimestamp())
    return len(files)


def read_raw(spark: SparkSession, raw: str, recent_only: bool) -> dict[str, DataFrame]:
    """The raw tables; a recent-only run reads the last two months and no legacy tables."""
    feeds = {}
    for feed, fields in FIELDS.items():
        path = f"{raw}/{feed}"
        schema = ", ".join(f"`{c}` {t}" for c, t in fields.items())
        if feed in MONTH_PARTITIONED and list_partitions(spark, path, "month"):
            feeds[feed] = read_last_partitions(spark, path, 2 if recent_only else None).drop("month")
        else:
            feeds[feed] = read_or_empty(spark, path, schema)
    if all(exists(spark, f"{raw}/{name}") for name in LEGACY):
        for name, schema in LEGACY.items():
            feeds[name] = read_legacy(spark, f"{raw}/{name}", schema, recent_only)
    return feeds


def run(
    spark: SparkSession,
    landing: str,
    raw: str,
    serving: str,
    scorer: Callable[[np.ndarray], np.ndarray],
    recent_only: bool = True,
    upsert_hours: int | None = None,
    now: Column | None = None,
    length: int = 168,
) -> dict[str, str]:
    """One whole batch run; returns the landing outcome per feed."""
    with workspace(spark):
        outcome = land_feeds(spark, landing, raw, now)
        frames = transform(read_raw(spark, raw, recent_only), scorer, length=length, rates=f"{raw}/rates")
        publish_all(spark, serving, frames, now if now is not None else F.localtimestamp(), upsert_hours=upsert_hours)
    return outcome


def refresh_served(spark: SparkSession, serving: str, derived: str, since: Column | None = None) -> None:
    """Keeps the derived tables current from the serving tables: one pass of the poller.

    solar_hourly: the complete-hour means of the hours that changed rows touch, pruned to what solar
    still holds. dst_merged: rebuilt whole if dst or its predictions changed. What changed since the
    last pass is remembered in {derived}/polls; a pass that fails is repeated. `since` reads from a
    given time instead, and remembers nothing.
    """
    hours = refresh_buckets(spark, f"{serving}/solar", f"{derived}/solar_hourly", [], "time", SERVING["solar"], held_days=HELD_DAYS["solar"])
    merged = refresh_join(spark, f"{serving}/dst_predictions", f"{serving}/dst", f"{derived}/dst_merged")
    readers = {
        "solar": (lambda rows: hours(rows.select("time")), HELD_DAYS["solar"]),
        "dst_predictions": (merged, None),
        "dst": (merged, None),
    }
    with workspace(spark):
        for name, (apply, held) in readers.items():
            path = f"{serving}/{name}"
            if since is None:
                run_poll(spark, path, f"{derived}/polls", name, lambda rows, _, apply=apply: apply(rows), held_days=held)
            elif exists(spark, path):
                rows = change_feed(spark.read.parquet(path), since, held_days=held)
                if not rows.isEmpty():
                    apply(rows)


def stream_served(
    spark: SparkSession, stream: DataFrame, serving: str, derived: str, checkpoint: str, table: str, **options
) -> StreamingQuery:
    """Upserts a stream into a serving table at the table's cadence, derived tables kept current."""
    hooks = {
        "solar": refresh_buckets(spark, f"{serving}/solar", f"{derived}/solar_hourly", [], "time", SERVING["solar"], held_days=HELD_DAYS["solar"]),
        "dst": refresh_join(spark, f"{serving}/dst_predictions", f"{serving}/dst", f"{derived}/dst_merged"),
    }
    hooks["dst_predictions"] = hooks["dst"]
    options = {"trigger": cadence(table), "keep": RETENTION[table], **options}
    return upsert_stream(spark, stream, f"{serving}/{table}", checkpoint, ["time"], SERVING[table], after=hooks.get(table), **options)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m tidemark.plans.jobs", description="Run one batch.")
    for name in ("landing", "raw", "serving", "model"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--all-months", action="store_true", help="read the whole raw history")
    parser.add_argument("--upsert-hours", type=int, help="one lookback for every table")
    args = parser.parse_args(argv)
    scorer = OnnxScorer(args.model)
    outcome = run(build_session(), args.landing, args.raw, args.serving, scorer, not args.all_months, args.upsert_hours)
    for feed, state in outcome.items():
        print(f"{feed}: {state}")


if __name__ == "__main__":
    main()
