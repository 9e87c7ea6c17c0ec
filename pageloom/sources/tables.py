"""Page snapshots in, record tables and reports out."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
STATE_MARKS = {"ok": "✓", "warn": "!", "fail": "✕", "skip": "–", "none": "·"}
# ---------------------------------------------------------------------------


def read_pages(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Page snapshots or a fetch log; name columns to leave the markup unread."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def save_table(df: DataFrame, path: str, key: str | None = None, buckets: int = 64) -> None:
    """Replace a table.

    The rows go to a fresh folder beside the table first and take its place by
    renaming; nobody sees a half-written table, though for a moment between the two
    renames there is none. The old rows go last: if a rename fails, they are back in
    place and an error is raised. With ``key`` the rows are laid out by a
    hash bucket of it, so work on few readers opens few files.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer = df.write
    if key:
        # Rebalancing splits a bucket that outgrows the advisory size, so a reader
        # with a third of all rows does not end up in a single writer.
        out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        writer = out.hint("rebalance", "bucket").write.partitionBy("bucket")
    writer.mode("errorifexists").parquet(staging)
    hpath = jvm.org.apache.hadoop.fs.Path
    fs = hpath(path).getFileSystem(conf)
    replaced = fs.exists(hpath(path))
    if replaced and not _renamed(fs, hpath(path), hpath(old)):
        raise OSError(f"{path} cannot be moved aside; the new rows are in {staging}")
    if not _renamed(fs, hpath(staging), hpath(path)):
        if replaced and not _renamed(fs, hpath(old), hpath(path)):
            raise OSError(f"{path} is in {old} and cannot be moved back; the new rows are in {staging}")
        raise OSError(f"{path} is as it was; the new rows are in {staging} and cannot be moved")
    if replaced:
        fs.delete(hpath(old), True)


def _renamed(fs, source, target) -> bool:
    """Whether a folder has its new name; file systems report failure by a value or by an exception."""
    try:
        return fs.rename(source, target)
    except (Py4JJavaError, PySparkException):
        return False


def load_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.drop("bucket")


def save_nodes(nodes: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """The node table of a snapshot, bucketed and sorted by page.

    Rule runs read it in place, also where they join on the page and a node: their own
    rows, which are few, come to it. Choose ``buckets`` for a few hundred megabytes each.
    """
    writer = nodes.write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, "page_id").sortBy("page_id", "node_id").saveAsTable(table)
    return nodes.sparkSession.table(table)


def export_report(verdicts: DataFrame, stages: DataFrame) -> DataFrame:
    """One Markdown block per source, problems first; write it with ``.write.text``.

    ``verdicts``: ``source_id, name, url, overall, status``; ``stages``:
    ``source_id, stage_no, label, state, detail, ms``. The stages of a source are
    a handful, so joining them into one text is bounded.
    """
    mark = lambda c: F.coalesce(F.create_map(*[F.lit(x) for p in STATE_MARKS.items() for x in p])[c], F.lit(STATE_MARKS["none"]))
    tenths = F.floor((F.col("ms") + 50) / 100)
    took = F.when(F.col("ms") == 0, "").when(F.col("ms") < 1000, F.concat(F.col("ms").cast("string"), F.lit("ms"))).otherwise(
        F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s")))
    line = F.concat(F.lit("- "), mark(F.col("state")), F.lit(" "), F.col("label"), F.lit(": "), F.col("detail"), F.lit(" ("), took, F.lit(")"))
    lines = stages.groupBy("source_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("stage_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    rows = verdicts.join(lines, "source_id", "left")
    head = F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.col("url"), F.lit("\n"))
    body = F.when(F.col("overall") == "none", F.lit("not checked")).otherwise(
        F.concat(mark(F.col("overall")), F.lit(" "), F.col("status"), F.lit("\n"), F.coalesce("lines", F.lit(""))))
    rank = F.when(F.col("overall") == "fail", 0).when(F.col("overall") == "warn", 1).when(F.col("overall") == "none", 2).otherwise(3)
    return rows.orderBy(rank, "name", "source_id").select(F.concat(head, body).alias("text"))
