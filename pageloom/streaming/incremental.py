"""Keeping record tables current from streams.

Each job is a ``foreachBatch`` that appends what a batch brings to a table kept as
a log of changes (:mod:`pageloom.streaming.changelog`); every ``fold_every`` batches
the log is folded, which :meth:`ChangeLog.compact` may do as a job of its own as well. Of each key one row wins
whatever the order of arrival, so a replayed batch changes nothing. No operator keeps state in the
stream: a stateful de-duplication of addresses would grow without bound.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators.audit import outcome
from pageloom.operators.common import first_per_key
from pageloom.operators.lists import content_links
from pageloom.operators.nodes import shred_pages
from pageloom.operators.reading import daily_reading, latest_history, latest_positions, upsert_progress
from pageloom.session import Scratch
from pageloom.streaming.changelog import ChangeLog

FOLD_EVERY = 16  # batches
POSITIONS = "user_id long, url string, ratio float, updated_at timestamp_ntz"  # of a table that is not there yet


def _start(stream: DataFrame, checkpoint: str, run: Callable[[DataFrame, int], None], trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _stream_id(checkpoint: str) -> str:
    """Batches are numbered by checkpoint; another checkpoint begins numbers of its own."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def progress_table(spark: SparkSession, target: str, keep: int = 500) -> ChangeLog:
    return ChangeLog(spark, target, "user_id", lambda rows: latest_positions(rows, keep))


def stream_progress(events: DataFrame, target: str, checkpoint: str, keep: int = 500, fold_every: int = FOLD_EVERY, trigger: dict | None = None) -> StreamingQuery:
    """Reading positions to the latest clamped position per reader and address.

    ``events``: ``user_id, url, ratio_raw, updated_at, event_id``. :func:`progress_table` reads the result.
    """
    table = progress_table(events.sparkSession, target, keep)

    def run(batch: DataFrame, n: int) -> None:
        table.append(upsert_progress(None, batch, keep, with_event=True), _stream_id(checkpoint), n)
        table.compact(fold_every)

    return _start(events, checkpoint, run, trigger)


def audit_table(spark: SparkSession, target: str) -> ChangeLog:
    return ChangeLog(spark, target, "source_id", lambda rows: first_per_key(rows, ["source_id"], [-F.col("checked_s"), -F.col("run_no")]))


def stream_audit(results: DataFrame, target: str, checkpoint: str, fold_every: int = FOLD_EVERY, trigger: dict | None = None) -> StreamingQuery:
    """Audit results to the latest verdict per source.

    ``results``: ``source_id, run_no, checked_s, ok, any_fail, any_warn``. :func:`audit_table` reads the
    result, :func:`audit_counters` counts over it.
    """
    table = audit_table(results.sparkSession, target)

    def run(batch: DataFrame, n: int) -> None:
        table.append(batch, _stream_id(checkpoint), n)
        table.compact(fold_every)

    return _start(results, checkpoint, run, trigger)


def audit_counters(latest: DataFrame) -> DataFrame:
    kind = outcome()
    return latest.agg(F.count("*").alias("total"), F.count_if(kind == "ok").alias("ok"),
                      F.count_if(kind == "warn").alias("warn"), F.count_if(kind == "failed").alias("failed"))


def links_table(spark: SparkSession, target: str) -> ChangeLog:
    return ChangeLog(spark, target, "link", lambda rows: first_per_key(rows, ["source_no", "link"], [F.col("page_id"), F.col("ix")]))


def stream_pages(pages: DataFrame, target: str, checkpoint: str, fold_every: int = FOLD_EVERY, trigger: dict | None = None) -> StreamingQuery:
    """Page snapshots to the links of each source not seen before.

    ``pages``: ``page_id, url, html, source_no``. Whatever a source listed first
    stays; later pages only add what is new. :func:`links_table` reads the result.
    """
    table = links_table(pages.sparkSession, target)

    def run(batch: DataFrame, n: int) -> None:
        # Shredding is the costly part and is read several times below.
        with Scratch(batch.sparkSession) as scratch:
            nodes = scratch.keep(shred_pages(batch), "nodes")
            links = content_links(nodes, batch).join(batch.select("page_id", "source_no"), "page_id")
            table.append(links.select("source_no", "link", "title", "kind", "page_id", "ix"), _stream_id(checkpoint), n)
        table.compact(fold_every)

    return _start(pages, checkpoint, run, trigger)


def _last_written(rows: DataFrame) -> DataFrame:
    """The days that were written last for each reader."""
    last = rows.groupBy("user_id").agg(F.max("written_us").alias("_last"))
    return rows.join(last, "user_id").filter(F.col("written_us") == F.col("_last")).drop("_last")


def reading_tables(spark: SparkSession, history: str, progress: str, daily: str) -> tuple[ChangeLog, ChangeLog, ChangeLog]:
    return ChangeLog(spark, history, "user_id", latest_history), progress_table(spark, progress), ChangeLog(spark, daily, "user_id", _last_written)


def _tagged(kind: str, stream: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    there = [F.col(c) if c in stream.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    return stream.select(F.lit(kind).alias("_kind"), *there)


def stream_reading_minutes(opened: DataFrame, positions: DataFrame, history: str, progress: str, daily: str, checkpoint: str,
                           tz: str = "UTC", fold_every: int = FOLD_EVERY, trigger: dict | None = None) -> StreamingQuery:
    """I4: history, positions and daily totals kept from the two record streams, read as one.

    Both streams are tagged and united, so a batch holds what has arrived of either and
    the two keep step; ``trigger`` may be ``{"processingTime": "1 minute"}`` for a job that goes on.
    A late position changes the window of an article already counted, and the
    30-minute cap makes that change unequal to an increment; so the days of every
    reader a batch touches are computed anew from the stored records. :func:`reading_tables` reads the results.
    """
    spark = opened.sparkSession
    stored, placed, days = reading_tables(spark, history, progress, daily)
    columns = {f.name: f.dataType for s in (opened, positions) for f in s.schema}

    def run(batch: DataFrame, n: int) -> None:
        name = _stream_id(checkpoint)
        with Scratch(spark) as scratch:
            batch = scratch.keep(batch, "batch")
            stored.append(batch.filter("_kind = 'opened'").select(opened.columns), name, n)
            placed.append(upsert_progress(None, batch.filter("_kind = 'position'").select(positions.columns), with_event=True), name, n)
            users = scratch.keep(batch.select("user_id").distinct(), "users")
            buckets = [r[0] for r in users.select(stored.bucket()).distinct().collect()]  # at most as many numbers as there are buckets
            if buckets:
                mine = lambda table: table.read(buckets).join(users, "user_id", "left_semi")
                fresh = daily_reading(mine(stored), mine(placed), tz)
                days.append(fresh.withColumn("written_us", F.lit(time.time_ns() // 1000)), name, n)
        for table in (stored, placed, days):
            table.compact(fold_every)

    both = _tagged("opened", opened, columns).unionByName(_tagged("position", positions, columns))
    return _start(both, checkpoint, run, trigger)
