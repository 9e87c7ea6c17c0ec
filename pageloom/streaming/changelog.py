"""Tables kept as a log of changes with a folded base.

``path/log/<stream>-<batch>`` holds the rows of one batch and nothing else, so a
batch costs what it brings. ``path/base/<version>`` holds the folded rows of all batches
up to some, by hash buckets of the key. Readers take the newest complete base and
the batches it does not have, and keep what the table's ``fold`` keeps of each
key. :meth:`ChangeLog.compact` is a job of its own that writes the next base and
removes what no reader needs any more: batches that the base before it has, and
bases older than that one, so a reader that began earlier still finds its files.

Writing a batch again replaces its own folder; one that a base has already is
left out by its number. So a replay changes nothing, wherever the job died.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str, key: str, fold: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.key, self.fold = spark, path.rstrip("/"), key, fold

    def _fs(self, folder: str):
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), hpath

    def _names(self, folder: str) -> list[str]:
        fs, hpath = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(hpath)) if fs.exists(hpath) else []

    def _complete(self, folder: str) -> bool:
        fs, hpath = self._fs(f"{self.path}/{folder}/_SUCCESS")
        return fs.exists(hpath)

    def _remove(self, folder: str) -> None:
        fs, hpath = self._fs(f"{self.path}/{folder}")
        fs.delete(hpath, True)

    def _versions(self) -> list[str]:
        return [v for v in self._names("base") if self._complete(f"base/{v}/folded")]

    def _folded(self, version: str | None) -> dict[str, int]:
        """The last batch of each stream that a base has; one row a stream."""
        if version is None:
            return {}
        return {r["stream"]: r["batch"] for r in self.spark.read.parquet(f"{self.path}/base/{version}/folded").collect()}

    def _waiting(self, version: str | None) -> list[tuple[str, str, int]]:
        """The batches a base does not have: folder, stream, number."""
        folded, out = self._folded(version), []
        for name in self._names("log"):
            stream, _, batch = name.rpartition("-")
            if int(batch) > folded.get(stream, -1) and self._complete(f"log/{name}"):
                out.append((name, stream, int(batch)))
        return out

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int")

    def append(self, rows: DataFrame, stream: str, batch: int) -> None:
        """The rows of one batch, what :meth:`fold` keeps of them."""
        self.fold(rows).write.mode("overwrite").parquet(f"{self.path}/log/{stream}-{batch:012d}")

    def exists(self) -> bool:
        return bool(self._versions() or self._waiting(None))

    def _rows(self, version: str | None, waiting: list[tuple[str, str, int]], buckets: Iterable[int] | None) -> DataFrame:
        parts = []
        if version is not None:
            base = self.spark.read.parquet(f"{self.path}/base/{version}/rows")
            parts.append((base if buckets is None else base.filter(F.col("bucket").isin(list(buckets)))).drop("bucket"))
        if waiting:
            log = self.spark.read.parquet(*[f"{self.path}/log/{name}" for name, _, _ in waiting])
            parts.append(log if buckets is None else log.filter(self.bucket().isin(list(buckets))))
        if not parts:
            raise FileNotFoundError(f"no rows in {self.path}")
        return self.fold(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table as it stands, or those buckets of it."""
        version = max(self._versions(), default=None)
        return self._rows(version, self._waiting(version), buckets)

    def compact(self, least: int = 1) -> bool:
        """Fold the log into a new base if it has ``least`` batches waiting; whether it had."""
        versions = self._versions()
        last = max(versions, default=None)
        waiting = self._waiting(last)
        if len(waiting) < least:
            return False
        folder = f"base/{0 if last is None else int(last) + 1:012d}"
        self._remove(folder)  # what a job that died has left
        rows = self._rows(last, waiting, None).withColumn("bucket", self.bucket())
        # Rebalancing splits a bucket that outgrows the advisory size.
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}/rows")
        before = self._folded(last)
        after = dict(before)
        for _, stream, batch in waiting:
            after[stream] = max(batch, after.get(stream, -1))
        self.spark.createDataFrame(list(after.items()), "stream string, batch long").coalesce(1).write.parquet(f"{self.path}/{folder}/folded")
        for name in self._names("log"):
            stream, _, batch = name.rpartition("-")
            if int(batch) <= before.get(stream, -1):
                self._remove(f"log/{name}")
        for version in versions[:-1]:
            self._remove(f"base/{version}")
        return True
