"""Incremental jobs (I): the given tables replayed as streams until drained.

A drained stream must leave what the batch operator computes, so the SQL of the
batch side is the SQL of these.
"""

from __future__ import annotations

import os
import uuid

from pageloom.plans.q_audit import LATEST, _health
from pageloom.plans.q_reading import READING
from pageloom.plans.q_lists import LINKS
from pageloom.plans.registry import query
from pageloom.plans.tables import duck_sql, rule_pages, table
from pageloom.session import shared_dir
from pageloom.streaming import incremental as inc


def _replay(df, parts: int = 3):
    """``df`` as a file stream of ``parts`` batches; its folder, target and checkpoint."""
    spark = df.sparkSession
    root = os.path.join(shared_dir(spark), "streams", uuid.uuid4().hex)
    df.repartition(parts).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return stream, f"{root}/out", f"{root}/checkpoint"


@query("i1_stream_progress", duck_sql("fx_progress") + "SELECT user_id, url, ratio, updated_at FROM fx_progress")
def i1(spark, sf):
    stream, target, checkpoint = _replay(table(spark, sf, "fx_progress_events"))
    inc.stream_progress(stream, target, checkpoint).awaitTermination()
    return inc.progress_table(spark, target).read().select("user_id", "url", "ratio", "updated_at")


@query("i2_stream_audit", LATEST + "SELECT source_id, run_no, ok FROM latest")
def i2(spark, sf):
    health = _health(spark, sf).select("source_id", "run_no", "checked_s", "ok", "any_fail", "any_warn")
    stream, target, checkpoint = _replay(health)
    inc.stream_audit(stream, target, checkpoint).awaitTermination()
    return inc.audit_table(spark, target).read().select("source_id", "run_no", "ok")


@query("i3_stream_pages", LINKS + "SELECT DISTINCT CAST(page_id % 12 AS INT) AS source_no, link FROM numbered WHERE n <= 200")
def i3(spark, sf):
    stream, target, checkpoint = _replay(rule_pages(spark, sf))
    inc.stream_pages(stream, target, checkpoint).awaitTermination()
    return inc.links_table(spark, target).read().select("source_no", "link")


@query("i4_stream_reading_minutes", READING + "SELECT user_id, day, articles, secs FROM daily")
def i4(spark, sf):
    opened, root, checkpoint = _replay(table(spark, sf, "fx_opened"), 2)
    positions, _, _ = _replay(table(spark, sf, "fx_progress_events"), 2)
    tables = f"{root}/history", f"{root}/progress", f"{root}/daily"
    inc.stream_reading_minutes(opened, positions, *tables, checkpoint).awaitTermination()
    return inc.reading_tables(spark, *tables)[2].read().select("user_id", "day", "articles", "secs")
