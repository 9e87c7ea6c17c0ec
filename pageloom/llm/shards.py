"""Token-id shards with a minimal perfect hash index.

Documents are sorted by key over range partitions; each becomes one file: the
raw ids of its documents one after the other (16 bits each if the vocabulary
allows, else 32), then the index. The index maps a key to its record: keys hash
to buckets of about ``PER_BUCKET``; each bucket, the largest first, gets the
first seed that sends all its keys to free slots, and a bucket of one key simply
names its slot. There are as many slots as keys, and a slot holds a fingerprint
of its key and the place of the record, so a look-up reads one seed and one
slot, and a key that is not there fails the fingerprint.

A task writes under a name of its own and reports it; the written table of these
reports (the manifest) says which files count, so an attempt that is lost or
repeated leaves files that nobody reads, which are then removed.

Defined results: a null text is an empty one: its record has the end id alone.
Records of null keys come first, are read back, and are not in the index. Rows
with one key are ordered by a hash of their text; the index knows the first in
each file and how many follow it. An empty table gives an empty set of shards.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.arrays import mix, slices
from pageloom.llm.tables import bare
from pageloom.llm.tokens import TOGETHER, Encoder
from pageloom.session import materialize

END = 2
PER_BUCKET = 4
SHARD_BYTES = 64 << 20  # of text, about
MAGIC = b"TOKSHRD1"
# At the end of a file: ids' width; records; keys; buckets; places of the record table, the seeds and the slots; the magic.
_TAIL = "<7Q8s"
_RECORD = np.dtype([("key", "<i8"), ("known", "<u8"), ("start", "<u8")])
_SLOT = np.dtype([("print", "<u4"), ("run", "<u4"), ("record", "<u8")])


def _hash(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """Hashes of keys by one seed, or by each of a column of seeds."""
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64) + np.asarray(seed, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the buckets (a slot, less by one and negative, for a bucket of one key) and each key's slot."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buckets = -(-n // PER_BUCKET)
    of = (_hash(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(buckets + 1))
    size = np.diff(first)
    seeds, slots, taken = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    tries = 256
    for b in np.argsort(-size, kind="stable"):
        if size[b] < 2:
            break
        mine, seed = order[first[b]: first[b + 1]], 1
        while True:
            # Some seeds at once; the first that sends the keys to different free slots counts.
            at = (_hash(keys[mine], np.arange(seed, seed + tries)[:, None]) % np.uint64(n)).astype(np.int64)
            row = np.sort(at, axis=1)
            good = np.flatnonzero(~taken[at].any(axis=1) & (row[:, 1:] != row[:, :-1]).all(axis=1))
            if len(good):
                seeds[b], slots[mine] = seed + good[0], at[good[0]]
                taken[at[good[0]]] = True
                break
            seed += tries
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(size == 1)
    slots[order[first[single]]] = free[: len(single)]
    seeds[single] = -free[: len(single)] - 1
    return seeds, slots


class ShardWriter:
    """One file of records in ascending order of keys."""

    def __init__(self, folder: str, width: int):
        files, path = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.ids"
        self.out = files.open_output_stream(f"{path}/{self.name}")
        self.width, self.place = width, 0
        self.keys: list[int | None] = []
        self.starts: list[int] = []

    def add(self, key: int | None, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        self.out.write(ids.astype("<u2").tobytes() if self.width == 2 else raw)
        self.keys.append(key)
        self.starts.append(self.place)
        self.place += len(ids)

    def close(self) -> None:
        n = len(self.keys)
        records = np.zeros(n + 1, _RECORD)
        records["known"][:n] = [k is not None for k in self.keys]
        records["key"][:n] = [k or 0 for k in self.keys]
        records["start"] = [*self.starts, self.place]
        at = np.flatnonzero(records["known"][:n])
        keys, begin, run = np.unique(records["key"][at], return_index=True, return_counts=True)
        seeds, slots = perfect_hash(keys)
        table = np.zeros(len(keys), _SLOT)
        table["print"][slots] = _hash(keys, -1) >> np.uint64(32)
        table["run"][slots], table["record"][slots] = run, at[begin] if len(keys) else 0
        places, here = [], self.place * self.width
        for part in (records, seeds.astype("<i8"), table):
            places.append(here)
            self.out.write(part.tobytes())
            here += part.nbytes
        self.out.write(struct.pack(_TAIL, self.width, n, len(keys), len(seeds), *places, MAGIC))
        self.out.close()


class ShardReader:
    """A shard's records in order, or by key."""

    def __init__(self, folder: str, name: str):
        files, path = pa.fs.FileSystem.from_uri(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        size = self.file.size()
        self.width, self.n, self.n_keys, self.buckets, self.records_at, self.seeds_at, self.slots_at, magic = struct.unpack(_TAIL, 
            self.file.read_at(struct.calcsize(_TAIL), size - struct.calcsize(_TAIL)))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a shard of token ids")

    def records(self, low: int, high: int) -> np.ndarray:
        """Records ``low`` to ``high`` and the one after, which says where the last ends."""
        return np.frombuffer(self.file.read_at((high - low + 1) * _RECORD.itemsize, self.records_at + low * _RECORD.itemsize), _RECORD)

    def ids(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.width, start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def find(self, key: int) -> tuple[int, int] | None:
        """The first record of a key and how many it has; reads one seed, one slot and one record."""
        if not self.n_keys:
            return None
        own = np.array([key], np.int64)
        bucket = int(_hash(own, 0)[0] % np.uint64(self.buckets))
        seed = struct.unpack("<q", self.file.read_at(8, self.seeds_at + 8 * bucket))[0]
        slot = -seed - 1 if seed < 0 else int(_hash(own, seed)[0] % np.uint64(self.n_keys))
        found = np.frombuffer(self.file.read_at(_SLOT.itemsize, self.slots_at + slot * _SLOT.itemsize), _SLOT)[0]
        if found["print"] != int(_hash(own, -1)[0]) >> 32 or self.records(int(found["record"]), int(found["record"]))[0]["key"] != key:
            return None
        return int(found["record"]), int(found["run"])

    def find_all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many keys those that are there, as places in ``keys``, the first record and how many each has; reads the whole index once."""
        none = np.zeros(0, np.int64)
        if not self.n_keys or not len(keys):
            return none, none, none
        seeds = np.frombuffer(self.file.read_at(8 * self.buckets, self.seeds_at), "<i8")
        slots = np.frombuffer(self.file.read_at(_SLOT.itemsize * self.n_keys, self.slots_at), _SLOT)
        seed = seeds[(_hash(keys, 0) % np.uint64(self.buckets)).astype(np.int64)]
        found = slots[np.where(seed < 0, -seed - 1, (_hash(keys, seed) % np.uint64(self.n_keys)).astype(np.int64))]
        first = found["record"].astype(np.int64)
        at = np.flatnonzero((found["print"] == _hash(keys, -1) >> np.uint64(32)) & (self.records(0, self.n)["key"][first] == keys))
        return at, first[at], found["run"][at].astype(np.int64)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END,
                 n_shards: int | None = None) -> DataFrame:
    """Write ``docs`` as shards; returns the manifest: ``shard``, ``file``, ``n_records``, ``n_ids``, ``low``, ``high``, ``start``.

    ``folder`` is one that all executors and later readers share; the manifest
    is kept in it, too. Keys are 64-bit integers.
    """
    spark = docs.sparkSession
    read = bare(docs, key, text).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    if n_shards is None:
        n_shards = max(1, -(-(read.agg(F.sum(16 + F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0) // SHARD_BYTES), 2 * spark.sparkContext.defaultParallelism)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing, writer = Encoder.of(tokenizer), np.array([end], "<u4").tobytes(), None
        for batch in (part for batch in batches for part in slices(batch, "text", TOGETHER)):
            if writer is None:
                writer = ShardWriter(f"{folder}/files", 2 if max(end, encoder.tokenizer.get_vocab_size()) < 1 << 16 else 4)
            for k, raw in zip(batch.column("key").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                writer.add(k, raw + closing)
        if writer is not None:
            writer.close()
            known = [k for k in writer.keys if k is not None]
            yield pa.RecordBatch.from_pylist([{
                "file": writer.name, "n_records": len(writer.keys), "n_ids": writer.place,
                "low": known[0] if known else None, "high": known[-1] if known else None}], schema=report)

    report = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
    (read.repartitionByRange(n_shards, "key", "mark").sortWithinPartitions("key", "mark").select("key", "text")
     .mapInArrow(written, "file string, n_records long, n_ids long, low long, high long")
     .withColumn("shard", F.spark_partition_id()).write.parquet(f"{folder}/reports"))
    reports = spark.read.parquet(f"{folder}/reports")
    # Shards follow each other by number; a row for each shard, so one task orders them.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    reports.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).write.parquet(f"{folder}/manifest")
    _drop_strays(folder, {r.file for r in reports.select("file").toLocalIterator()})
    return spark.read.parquet(f"{folder}/manifest")


def _drop_strays(folder: str, named: set[str]) -> None:
    """Remove what lost or repeated attempts have left."""
    files, path = pa.fs.FileSystem.from_uri(folder)
    for found in files.get_file_info(pa.fs.FileSelector(f"{path}/files", allow_not_found=True)):
        if found.base_name not in named:
            files.delete_file(found.path)


def _batches(shard: ShardReader, base: int, number: int, low: int, high: int, known: bool = True) -> Iterator[pa.RecordBatch]:
    """Records ``low`` to ``high`` of a shard, some at a time; without ``known`` those of null keys, which are the first."""
    for low in range(low, high, 512):
        table = shard.records(low, min(high, low + 512))
        if not known:
            table = table[: np.count_nonzero(table["known"][:-1] == 0) + 1]
        if len(table) > 1:
            start = table["start"].astype(np.int64)
            ids, cuts = shard.ids(int(start[0]), int(start[-1])), (start - start[0]).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([int(k) if has else None for k, has in zip(table["key"][:-1], table["known"][:-1])], pa.int64()),
                pa.array([number] * (len(table) - 1), pa.int32()), pa.array(start[:-1] + base), pa.array(np.diff(start)),
                pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["key", "shard", "start", "n_tokens", "ids"])
        if not known and len(table) < min(high, low + 512) - low + 1:
            return


_RECORDS = "key long, shard int, start long, n_tokens long, ids binary"


def read_shards(spark: SparkSession, folder: str, keep=lambda ids: ids, known: bool = True) -> DataFrame:
    """Every record: ``key``, ``shard``, ``start`` (ids of all records before it), ``n_tokens``, ``ids`` as little-endian 32-bit bytes.

    ``keep`` is what is made of the ids in the plan; without ``known``, only the
    records of null keys, which no index knows, are read.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "file", "start")

    def records(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for row in batch.to_pylist():
                shard = ShardReader(f"{folder}/files", row["file"])
                yield from _batches(shard, row["start"], row["shard"], 0, shard.n, known)

    tasks = max(1, min(manifest.count(), 1 << 16))
    out = manifest.repartition(tasks, "shard").mapInArrow(records, _RECORDS)
    return out.withColumn("ids", keep(F.col("ids")))


def _routed(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each different key with the shards whose range it is in (several where its rows go on in the next).

    The ranges are searched by bisection in every task; there is one for each ``SHARD_BYTES`` of text, 16 bytes of them for 64 MB.
    """
    ranges = manifest.filter("low is not null").select("shard", "low", "high").orderBy("shard").toPandas()
    shard, lows, highs = (ranges[c].to_numpy(np.int64) for c in ("shard", "low", "high"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            first = np.searchsorted(highs, key, "left")
            n = np.maximum(np.searchsorted(lows, key, "right") - first, 0)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, n)), pa.array(shard[np.repeat(first, n) + place].astype(np.int32))], names=["key", "shard"])

    return keys.filter("key is not null").distinct().mapInArrow(route, "key long, shard int")


def lookup(keys: DataFrame, folder: str, key: str = "doc_id", many: bool = False, keep=lambda ids: ids) -> DataFrame:
    """The records of given keys, each by its index: ``key``, ``shard``, ``start``, ``n_tokens``, ``ids``; none for keys that are not there.

    A key reads one seed, one slot and one record. With ``many`` keys, a large
    part of all, a shard's index is read once for all keys that go there, and records that
    follow each other are read together.
    """
    manifest = keys.sparkSession.read.parquet(f"{folder}/manifest")
    routed = _routed(keys.select(F.col(key).cast("bigint").alias("key")), manifest).join(manifest.select("shard", "file", "start"), "shard")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            of, wanted = batch.column("file").to_numpy(zero_copy_only=False), batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if of[a] != name:
                    shard, name = ShardReader(f"{folder}/files", of[a]), of[a]
                if many:
                    _, first, run = shard.find_all(wanted[a:b])
                else:
                    hits = [hit for hit in map(shard.find, wanted[a:b].tolist()) if hit]
                    first, run = (np.array([hit[i] for hit in hits], np.int64) for i in (0, 1))
                if not len(first):
                    continue
                order = np.argsort(first)
                first, last = first[order], (first + run)[order]
                breaks = np.flatnonzero(first[1:] != last[:-1]) + 1
                for low, high in zip(first[[0, *breaks]].tolist(), last[[*(breaks - 1), -1]].tolist()):
                    yield from _batches(shard, batch.column("start")[a].as_py(), batch.column("shard")[a].as_py(), low, high)

    out = routed.repartition("shard").sortWithinPartitions("shard", "key").select("key", "shard", "file", "start").mapInArrow(found, _RECORDS)
    return out.withColumn("ids", keep(F.col("ids")))


def read_by_key(keys: DataFrame, folder: str, key: str = "doc_id", keep=lambda ids: ids) -> DataFrame:
    """What :func:`read_shards` gives, each known key found by its shard's index; null keys, which have none, are read in order.

    ``keys`` has all keys of the shards. That their records are all those written, and their ids, is checked.
    """
    spark = keys.sparkSession
    out = materialize(lookup(keys, folder, key, many=True, keep=keep).union(read_shards(spark, folder, keep=keep, known=False)), "by-key")
    have = out.agg(F.count("*"), F.sum("n_tokens")).first()
    want = spark.read.parquet(f"{folder}/manifest").agg(F.sum("n_records"), F.sum("n_ids")).first()
    if (have[0], have[1] or 0) != (want[0] or 0, want[1] or 0):
        raise RuntimeError(f"the index found {have[0]} records with {have[1]} ids, but {want[0]} with {want[1]} were written")
    return out


def crc(ids: Column) -> Column:
    return F.crc32(ids)
