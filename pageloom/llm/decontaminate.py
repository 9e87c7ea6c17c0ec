"""Benchmark decontamination by winnowing.

Of every ten neighbouring words (a window) the smallest of its 5-gram hashes is
kept as a fingerprint, so a span of ten or more words that a document shares
with a benchmark item has a fingerprint in both. Fingerprints of documents that
a Bloom filter of the benchmark's cannot rule out keep the windows around them;
a join on the fingerprint extends each to the whole window, word by word.

The filter has a fixed size whatever the benchmark's: a larger benchmark only
fills it, and then more windows reach the join.

Defined results: null and wordless texts have no words and no hits; an item of
one to nine words is one window of that length; an item without words has none.
Each input row gives one row, rows repeated or with a null key included. Items
with the same text are all counted. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.arrays import grams, mix, slices, text_buffer, words
from pageloom.llm.tables import bare
from pageloom.session import Scratch, materialize

WINDOW = 10  # words
GRAM = 5  # words; a window has WINDOW - GRAM + 1 of them
FILTER_BITS = 1 << 24  # 2 MB, the bound of what is broadcast
FILTER_HASHES = 4

_SPANS = "key long, mark long, n_words long, windows array<struct<start: int, length: int, mark: long, words: string>>"


def _bits(marks: np.ndarray) -> np.ndarray:
    """The filter's bits of each mark, one row for each hash."""
    with np.errstate(over="ignore"):
        step = mix(marks) | np.uint64(1)
        return np.stack([(marks + np.uint64(i) * step) % np.uint64(FILTER_BITS) for i in range(FILTER_HASHES)])


def _fingerprints(hashes: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of the window of ``length`` words that begins at each word."""
    if length < WINDOW:
        return mix(grams(hashes, length) ^ np.uint64(length))
    low = grams(hashes, GRAM)
    n = max(0, len(hashes) - length + 1)
    out = low[:n].copy()
    for j in range(1, length - GRAM + 1):
        np.minimum(out, low[j: j + n], out=out)
    return out


def _windows(batches: Iterator[pa.RecordBatch], key: str, text: str, lengths: list[int] | None,
             known: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """A row for each text with its windows: those the filter lets pass, or all of them.

    ``lengths`` are those to look for; None means the text is an item: windows
    of ``WINDOW`` words, or one of all words if there are fewer.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("mark", pa.int64()), ("words", pa.string())]))
    bits = None if known is None else np.frombuffer(known.value, np.uint8)
    for batch in batches:
        for part in slices(batch, text):
            buffer, borders = text_buffer(part.column(text))
            spans, low = words(buffer, borders)
            count, of = np.diff(spans.first), spans.text
            found = []
            for length in lengths or range(1, WINDOW + 1):
                marks = _fingerprints(spans.hash, length)
                ok = np.arange(len(marks)) + length <= spans.first[1:][of[: len(marks)]]
                if lengths is None and length < WINDOW:
                    ok &= count[of[: len(marks)]] == length
                if bits is not None:
                    at = np.flatnonzero(ok)
                    for b in _bits(marks[at]):
                        ok[at] &= (bits[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 > 0
                at = np.flatnonzero(ok)
                found.append((np.stack([of[at], at, np.full(len(at), length)]), marks[at]))
            rows = np.concatenate([f[0] for f in found], axis=1)
            marks = np.concatenate([f[1] for f in found])
            order = np.argsort(rows[0], kind="stable")
            rows, marks = rows[:, order], marks[order]
            start, length = rows[1], rows[2]
            cut = [b" ".join([low[spans.start[w]: spans.end[w]].tobytes() for w in range(s, s + m)]).decode("utf-8", "replace")
                   for s, m in zip(start.tolist(), length.tolist())]
            values = pa.StructArray.from_arrays(
                [pa.array((start - spans.first[rows[0]]).astype(np.int32)), pa.array(length.astype(np.int32)),
                 pa.array(marks.view(np.int64)), pa.array(cut, pa.string())], names=["start", "length", "mark", "words"])
            offsets = pa.array(np.searchsorted(rows[0], np.arange(len(count) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(key).cast(pa.int64()), part.column("mark"), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(offsets, values).cast(kind)],
                names=["key", "mark", "n_words", "windows"])


def _filter(marks: DataFrame) -> bytes:
    """A Bloom filter of the marks; each 64-bit word of it is or-ed together in Spark, at most FILTER_BITS / 64 of them."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(_bits(batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array((bits >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))],
                names=["word", "bits"])

    rows = marks.select("mark").distinct().mapInArrow(placed, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    if rows:
        out[[r.word for r in rows]] = np.array([r.bits for r in rows], np.int64).view(np.uint64)
    return out.tobytes()


def _marked(table: DataFrame, key: str, text: str) -> DataFrame:
    return bare(table, key, text).toDF("key", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """For each document its words, how many lie in windows of the benchmark, and the items those are of.

    Columns ``row`` (a number for each input row), the key, ``text_hash`` (tells
    rows with one key apart), ``n_words``, ``n_hit``, ``items`` (ids as strings, sorted), ``contaminated``.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        read = _marked(benchmark, item, item_text)
        known = scratch.keep(
            read.mapInArrow(lambda it: _windows(it, "key", "text", None, None), _SPANS)
            .select(F.col("key").alias("item"), F.explode("windows").alias("w")).select("item", "w.length", "w.mark", "w.words"), "known")
        lengths = sorted(r.length for r in known.select("length").distinct().collect())
        passing = spark.sparkContext.broadcast(_filter(known))
        seen = scratch.keep(
            _marked(docs, key, text)
            .mapInArrow(lambda it: _windows(it, "key", "text", lengths or [WINDOW], passing), _SPANS)
            .withColumn("row", F.monotonically_increasing_id()), "seen")
        # A window's items are looked up by its number, once per document, not once per place.
        numbered = scratch.keep(known.groupBy("mark", "words").agg(F.min("length").alias("length"))
                                .withColumn("window", F.monotonically_increasing_id()), "numbered")
        owners = known.join(numbered, ["mark", "words"]).select("window", "item").distinct()
        hits = scratch.keep(
            seen.select("row", F.explode("windows").alias("w")).select("row", "w.start", "w.mark", "w.words")
            .join(numbered, ["mark", "words"]).select("row", "window", F.col("start").cast("long"), "length"), "hits")
        before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("length")
        covered = (
            hits.select("row", "start", "length").withColumn("before", F.coalesce(F.max(end).over(before), F.lit(0)))
            .groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).alias("n_hit")))
        items = (
            hits.select("row", "window").distinct().join(owners, "window").select("row", "item").distinct()
            .groupBy("row").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items")))
        none = F.array().cast("array<string>")
        return materialize(
            seen.select("row", "key", F.col("mark").alias("text_hash"), "n_words").join(covered, "row", "left").join(items, "row", "left")
            .select("row", F.col("key").alias(key), "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                    F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")), "decontaminated")
