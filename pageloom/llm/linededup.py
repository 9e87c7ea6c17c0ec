"""Line dedup by content-defined chunks that grow.

A rolling hash over the hashes of ``SPAN`` lines chooses after which lines a chunk
ends; the chunk is what the hash has seen, so it moves with its content and no
text above or below it matters. Five lines in eight end one. A chunk that
stands in the corpus more than once stays where it stands first (in order of key,
text and place) and goes elsewhere. Where a chunk repeats, the pairs of lines between it and the next
chunks, which end at no boundary, are looked up as well: so a repeat grows
line by line until its bytes differ.

Chunks are first counted by hash alone, in rows of a few numbers. Only those
whose hash repeats, and what they grow into, are cut out of their texts and compared byte by byte, in a
join on hash and bytes with the first place of each, so a group of any number of
copies is an aggregate and a join with one row. Joins with the texts are by
sorting at every size: what they are joined with grows with them. Of a line that is removed
an equal one stands at an earlier place; following these places, one stays.

Defined results: a null text stays null, has no lines and loses none; an empty
text has one empty line. Single lines, and chunks of blank lines only, are
kept. A text all of whose lines are removed is left empty. Rows repeated or
with a null key are documents of their own. Extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.arrays import grams, lines, slices, text_buffer
from pageloom.llm.tables import bare
from pageloom.llm.tokens import let_go
from pageloom.session import Scratch, materialize, small_batches

SPAN = 2  # lines of a chunk: what the rolling hash sees
OF, BOUNDARIES = 8, 5  # so many lines of so many end a chunk


def _is_chunk(value):
    """Whether a boundary stands where the rolling hash has this value (a column or an array of 64-bit integers)."""
    return value % OF < BOUNDARIES if isinstance(value, np.ndarray) else F.pmod(value, F.lit(OF)) < BOUNDARIES


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text where its lines end (behind their line feeds), and the rolling hash of each line with the next; null for blank ones."""
    let_go()
    for batch in batches:
        for part in slices(batch, "text"):
            buffer, borders = text_buffer(part.column("text"))
            spans = lines(buffer, borders)
            ends = np.minimum(spans.end + 1, np.repeat(borders[1:], np.diff(spans.first))) - np.repeat(borders[:-1], np.diff(spans.first))
            rolling = grams(spans.hash, SPAN)
            filled = spans.end > spans.start
            inside = np.ones(len(rolling), bool)
            last = spans.first[1:] - 1
            inside[last[last < len(rolling)]] = False  # a text's last line has no next one
            said = inside & (filled[:-1] | filled[1:]) if len(rolling) else inside
            values = pa.array(np.append(rolling.view(np.int64), 0)[: len(ends)], mask=~np.append(said, False)[: len(ends)])
            offsets = pa.array(spans.first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("mark"), pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, values)], names=["key", "mark", "ends", "hashes"])


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that repeat, and the pairs of lines from them to the next chunks on either side."""
    for batch in batches:
        out = []
        for hashes, repeated in zip(batch.column("hashes"), batch.column("repeated")):
            value = hashes.values
            there = np.array(value.is_valid())
            chunk = there & _is_chunk(value.fill_null(0).to_numpy())
            seed = np.zeros(len(there), bool)
            seed[repeated.values.to_numpy()] = True
            # The nearest chunk on each side, or what ends a stretch of pairs.
            stop = chunk | ~there
            at = np.arange(len(there))
            before = np.maximum.accumulate(np.where(stop, at, -1))
            after = np.minimum.accumulate(np.where(stop, at, len(at))[::-1])[::-1]
            near = np.append(seed, False)
            out.append(np.flatnonzero(seed | (there & ~chunk & ((near[before] & (before >= 0)) | near[after]))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("mark"), batch.column("ends"), batch.column("hashes"), pa.array(out, pa.list_(pa.int32()))],
            names=["key", "mark", "ends", "hashes", "places"])


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", report: bool = True) -> DataFrame:
    """``docs`` with repeated chunks of lines taken out of its text, its other columns as they are.

    With ``report``, columns ``n_lines``, ``n_removed_lines``, ``n_removed_chunks``
    say what was removed; they take the place of columns of that name.
    Rows with one key are told apart by their text; those with the same text,
    too, are one document for finding repeats, and all are treated like it.
    """
    kind = docs.schema[key].dataType.simpleString()
    read = bare(docs, key, text).toDF("key", "text").filter("text is not null").withColumn("mark", F.xxhash64("text"))
    shape = f"key {kind}, mark long, n_lines long, chunks array<struct<at: int, start: long, length: long, hash: long, lines: int>>"
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        found = scratch.keep(read.mapInArrow(_lines, f"key {kind}, mark long, ends array<int>, hashes array<long>"), "lines")
        chunks = found.select("key", "mark", F.posexplode("hashes").alias("at", "hash")).filter(F.col("hash").isNotNull() & _is_chunk(F.col("hash")))
        place = F.struct("key", "mark", "at")
        repeated = chunks.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("z")).filter("a <> z").select("hash")
        doubtful = scratch.keep(chunks.join(repeated, "hash").groupBy("key", "mark").agg(F.collect_set("at").alias("repeated")), "doubtful")
        pair = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["mark"] == b["mark"])
        once = found.dropDuplicates(["key", "mark"])
        grown = scratch.keep(
            doubtful.join(once, pair(doubtful, once)).select(once["key"], once["mark"], "ends", "hashes", "repeated")
            .mapInArrow(_grown, f"key {kind}, mark long, ends array<int>, hashes array<long>, places array<int>"), "grown")
        start = lambda p: F.when(p > 0, F.get("ends", p - 1)).otherwise(0)
        wanted = grown.select("key", "mark", F.transform("places", lambda p: F.struct(
            p.alias("at"), start(p).alias("start"), F.get("ends", p + SPAN - 1).alias("end"), F.get("hashes", p).alias("hash"))).alias("cs"))
        # A pair's bytes without the line feed behind it, which a text's last line lacks.
        bytes_of = lambda whole, c: F.regexp_replace(F.substring(whole, c["start"] + 1, c["end"] - c["start"]).cast("string"), "\\n$", "")
        parts = F.transform(F.array(F.col("text").cast("binary")), lambda whole: F.transform(
            "cs", lambda c: F.struct(c["at"].alias("at"), c["hash"].alias("hash"), bytes_of(whole, c).alias("bytes"))))
        cut = scratch.keep(wanted.join(read.hint("merge"), pair(wanted, read)).select(wanted["key"], wanted["mark"], F.inline(F.get(parts, F.lit(0)))), "cut")
        firsts = cut.groupBy("hash", "bytes").agg(F.min(place).alias("first"))
        removed = scratch.keep(
            cut.join(firsts, ["hash", "bytes"]).filter(~place.eqNullSafe(F.col("first")))
            .groupBy("key", "mark").agg(F.collect_set("at").alias("gone")), "removed")
        # What is kept of the documents that lose something; the others' rows pass by.
        plan = removed.join(grown, pair(removed, grown)).select(removed["key"].alias("of_key"), removed["mark"].alias("of_mark"), "gone", "ends")
        lost = F.array_distinct(F.flatten(F.transform("gone", lambda at: F.array(*[at + i for i in range(SPAN)]))))
        plan = plan.withColumn("lost", F.map_from_arrays(lost, lost))
        left = F.filter(F.transform("ends", lambda e, i: F.struct(
            i.alias("at"), start(i).alias("start"), e.alias("end"))), lambda c: ~F.map_contains_key("lost", c["at"]))
        plan = plan.select(
            "of_key", "of_mark", F.size("gone").cast("long").alias("n_removed_chunks"), F.size("lost").cast("long").alias("n_removed_lines"),
            F.transform(left, lambda c: F.struct(c["start"].alias("start"), (c["end"] - c["start"]).alias("length"))).alias("left"))
        plan = materialize(plan, "removed-lines")
    mine, its = lambda c: F.col(f"docs.`{c}`"), lambda c: F.col(f"plan.{c}")
    kept = F.array_join(F.get(F.transform(F.array(mine(text).cast("binary")), lambda whole: F.transform(
        its("left"), lambda c: F.substring(whole, c["start"] + 1, c["length"]).cast("string"))), F.lit(0)), "")
    joined = docs.alias("docs").hint("merge").join(
        plan.alias("plan"), mine(key).eqNullSafe(its("of_key")) & (F.xxhash64(F.coalesce(mine(text), F.lit(""))) == its("of_mark")), "left")
    told = {
        "n_lines": F.when(mine(text).isNull(), 0).otherwise(F.length(mine(text)) - F.length(F.replace(mine(text), F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed_lines": F.coalesce(its("n_removed_lines"), F.lit(0)), "n_removed_chunks": F.coalesce(its("n_removed_chunks"), F.lit(0))} if report else {}
    changed = F.when(its("left").isNull() | mine(text).isNull(), mine(text)).otherwise(kept)
    out = joined.select(
        *[(changed if c == text else mine(c)).alias(c) for c in docs.columns if c not in told], *[value.alias(c) for c, value in told.items()])
    return out
