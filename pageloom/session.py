"""Session set-up and the places intermediate tables are written to."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "pageloom", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with AQE on and a fixed zone; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local run (a test, a notebook) that names none gets a folder of its own,
    set as the checkpoint folder of its context so that later calls agree. A
    cluster that names none is an error: no folder of the driver's would do.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    made = context.getCheckpointDir()
    if made is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
        made = context.getCheckpointDir()
    return made.rstrip("/")


@contextmanager
def joining_in_place(spark: SparkSession) -> Iterator[None]:
    """Plans made inside let a table that is laid out by one of a join's keys stay as it lies, and bring the other side to it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


BATCH_BYTES = 4 << 20  # of rows that go to Python together


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends rows to Python in batches of about :data:`BATCH_BYTES`, however long its texts.

    Spark counts a batch's rows, so ten thousand texts would lie together: as
    Arrow buffers beside the executor's heap and again in each of its workers.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


PART_BYTES = 128 << 20  # the size of a file split
SMALL_PART_BYTES = 256 << 10


def spread(df: DataFrame, key: str, small: int = SMALL_PART_BYTES) -> DataFrame:
    """``df`` in at least as many parts as there are cores.

    For work that is heavy per row. A small file read as one part would keep one
    core busy; a table whose splits occupy the cores is left alone, unshuffled.
    The decision uses the planner's size estimate and runs nothing. ``small`` is the
    estimate a part is worth having for, less where a few stored bytes make much work.
    """
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= want * PART_BYTES:
        return df
    return df.repartition(max(1, min(want, size // small + 1)), key)


_WRITTEN: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def drop_tables() -> None:
    """Remove every table :func:`materialize` wrote; runs by itself when the driver ends."""
    for path, spark in list(_WRITTEN.items()):
        del _WRITTEN[path]
        try:
            _remove(spark, path)
        except Exception:  # the context has ended already; the cluster clears its folder
            return


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage the way a checkpoint does, outlives lost executors,
    and unlike an RDD checkpoint keeps column pruning and filter pushdown for
    every reader of the result. The table stays until the driver ends, since
    lazy results may read it (:func:`drop_tables`).
    """
    path = os.path.join(shared_dir(df.sparkSession), "tables", f"{name}-{uuid.uuid4().hex}")
    _WRITTEN[path] = df.sparkSession
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_there(df: DataFrame) -> bool:
    """Do the files a written table is read from still exist?"""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return True


class Scratch:
    """Intermediate tables of one computation, removed together when it is done.

    ``keep(df, name)`` is :func:`materialize` into a folder of this computation.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = os.path.join(shared_dir(spark), "scratch", uuid.uuid4().hex)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.folder, name)
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        _remove(self.spark, self.folder)
