"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document
with a smaller key. Whole copies are settled by their text; of the others:

1. Each window of ``LENGTH`` bytes has an anchor, the ``GRAM``-byte string in it
   with the least hash (the last one of equals). Equal windows have equal
   anchors, at the same place in them. Anchors that stand in one text only are
   dropped.
2. Around each remaining anchor the stretch of windows that have it is cut out.
   Stretches with the same bytes are one, with the least key they stand at.
3. The different stretches of an anchor are concatenated and suffix-sorted
   (:mod:`pageloom.llm.suffixes`). Neighbours that share ``LENGTH`` bytes are
   equal windows; the least key among them decides for each. Stretches are
   first trimmed to windows whose hash repeats among them, which loses none.
4. Decisions go back to where the stretches stand, and each document's removed
   ranges are joined up.

An anchor with more than ``MOST`` different stretches is refined: its windows
are halved by where they begin before it, and each half is grouped by all bytes
its windows share. A half of one window is the window, so refining ends; a
passage in a third of all documents comes down to a few stretches, counted by
partial aggregates.

Defined results: a null text is an empty one. A null key comes before all
others. Rows with the same key do not remove each other's bytes; rows with the
same key and text are one document and each gives the row. Matches cross no
borders of documents. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.arrays import mix, slices, text_buffer
from pageloom.llm.suffixes import common_prefixes, suffix_array
from pageloom.llm.tables import bare, parts
from pageloom.session import Scratch, materialize

LENGTH = 50
GRAM = 24
PIECE = 1 << 18  # bytes of text taken at once, so that arrays stay in the cache
MOST = 256  # different stretches of an anchor that are sorted together


def _gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on."""
    n = max(0, len(buffer) - GRAM + 1)
    if not n:
        return np.zeros(0, np.uint64)
    word = buffer.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes each
        word = word[:-step] | (word[step:] << np.uint64(8 * step))
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for at in range(0, GRAM, 8):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[at: at + n]
        return mix(out)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = pick(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(buffer: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the first and the last window's start, the anchor's place and hash.

    Windows that would cross a border of texts are in no run.
    """
    none = np.zeros(0, np.int64)
    n, width = len(buffer) - LENGTH + 1, LENGTH - GRAM + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    hashes = _gram_hashes(buffer)
    least = _sliding(hashes, width, np.minimum)
    # Every place with the least hash of some window; a window's anchor is the last of these it reaches.
    most = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    is_place = most == hashes
    places = np.flatnonzero(is_place)
    value = hashes[places]
    at = np.cumsum(is_place, dtype=np.int32)[width - 1: width - 1 + n] - 1
    # Going back from the last place a window reaches to the last that has its least hash.
    wrong = np.flatnonzero(value[at] != least)
    while len(wrong):
        at[wrong] -= 1
        wrong = wrong[value[at[wrong]] != least[wrong]]
    long = np.diff(borders) >= LENGTH
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, borders[:-1][long], 1)
    np.add.at(edges, borders[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(edges[:n]) > 0)
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], places[at[first]], value[at[first]]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each text."""
    for batch in batches:
        for part in slices(batch, "text", PIECE):
            buffer, borders = text_buffer(part.column("text"))
            first, _, _, value = anchors(buffer, borders)
            marks = part.column("mark").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(marks[np.searchsorted(borders, first, "right") - 1])], names=["anchor", "mark"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor and mark, one for each of the two if the anchor has several marks.

    Rows pass in a stream. Of the anchor a batch ends with, only the last mark is
    held: with a second one behind it, or before it, it is let go.
    """
    held_anchor, held_mark, known = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "mark"))
        if held_anchor is not None:
            anchor, mark = np.append(held_anchor, anchor), np.append(held_mark, mark)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (mark[1:] != mark[:-1])
        anchor, mark = anchor[new], mark[new]
        same = anchor[1:] == anchor[:-1]
        several = np.append(same, False) | np.insert(same, 0, False)
        if held_anchor is not None and known and anchor[0] == held_anchor:
            several[0] = True
        yield pa.RecordBatch.from_arrays([pa.array(anchor[:-1][several[:-1]]), pa.array(mark[:-1][several[:-1]])], names=["anchor", "mark"])
        held_anchor, held_mark, known = anchor[-1], mark[-1], bool(several[-1])
    if held_anchor is not None and known:
        yield pa.RecordBatch.from_arrays([pa.array([held_anchor]), pa.array([held_mark])], names=["anchor", "mark"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches around each text's anchors that are listed with it."""
    for batch in batches:
        for part in slices(batch, "text", PIECE):
            buffer, borders = text_buffer(part.column("text"))
            first, last, place, value = anchors(buffer, borders)
            of = np.searchsorted(borders, first, "right") - 1
            listed = part.column("anchors")
            flat, counts = listed.flatten().to_numpy(zero_copy_only=False), listed.value_lengths().to_numpy(zero_copy_only=False)
            # Text and anchor as one number; should two be equal by chance, a stretch too many is looked at.
            with np.errstate(over="ignore"):
                known = flat.view(np.uint64) + mix(np.repeat(np.arange(part.num_rows), counts).astype(np.uint64))
                keep = np.isin(value + mix(of.astype(np.uint64)), known)
            first, last, place, value, of = first[keep], last[keep], place[keep], value[keep], of[keep]
            raw = buffer.tobytes()
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [part.column("ord").take(rows), part.column("mark").take(rows), pa.array(value.view(np.int64)), pa.array(first - borders[of]),
                 pa.array((first - place).astype(np.int32)), pa.array((last - place).astype(np.int32)),
                 pa.array([raw[a: b + LENGTH] for a, b in zip(first.tolist(), last.tolist())], pa.binary())],
                names=["ord", "mark", "group", "start", "low", "high", "bytes"])


def _complete(batches: Iterator[pa.RecordBatch], column: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups, of about ``rows`` rows unless a group has more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            values = table.column(column).to_numpy()
            cut = int(np.flatnonzero(np.append(True, values != values[-1]))[-1])
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _window_hashes(buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the ``LENGTH`` bytes from each of the given positions on."""
    word = buffer.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[:-step] | (word[step:] << np.uint64(8 * step))
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for at in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[starts + at]
        return mix(out)


def _least_keys(pieces: list[tuple[int, int, bytes]], keys: list[int]) -> dict[tuple[int, int], int]:
    """For windows (stretch, place) that several of a group's pieces have: the least key of those, by one suffix array.

    A piece is (stretch, place of its first window, bytes).
    """
    alike: dict[bytes, list[tuple[int, int]]] = {}
    for stretch, at, raw in pieces:
        alike.setdefault(raw, []).append((stretch, at))
    text: list[int] = []
    owner: list[tuple[bytes, int] | None] = []
    for k, raw in enumerate(alike):
        text += raw
        owner += [(raw, i) if i <= len(raw) - LENGTH else None for i in range(len(raw))]
        text.append(256 + k)  # parts pieces; each once
        owner.append(None)
    least = {raw: min(keys[stretch] for stretch, _ in places) for raw, places in alike.items()}
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    out: dict[tuple[int, int], int] = {}
    run: list[tuple[bytes, int]] = []
    for suffix, prefix in zip([*order, -1], [*shared, 0]):
        if prefix < LENGTH:
            if run:
                low = min(least[raw] for raw, _ in run)
                out.update({(stretch, at + i): low for raw, i in run for stretch, at in alike[raw]})
            run = []
        if suffix >= 0 and owner[suffix]:
            run.append(owner[suffix])
    return out


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each different stretch, runs of its windows with the least key at which each stands."""
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("least", pa.int64())]))
    for table in _complete(batches, "group"):
        group, low, high = (table.column(c).to_numpy() for c in ("group", "low", "high"))
        keys = table.column("least").to_pylist()
        buffer, borders = text_buffer(table.column("bytes").combine_chunks())
        count = (high - low + 1).astype(np.int64)
        of = np.repeat(np.arange(len(group)), count)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        value = _window_hashes(buffer, borders[of] + place)
        with np.errstate(over="ignore"):
            value = mix(value ^ mix(group[of].view(np.uint64)) + (low[of] + place).astype(np.int64).view(np.uint64))
        _, number, times = np.unique(value, return_inverse=True, return_counts=True)
        again = times[number] > 1
        raw, changed = buffer.tobytes(), {}
        at = np.flatnonzero(again)
        if len(at):
            cuts = np.flatnonzero((at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])) + 1
            runs = [(int(r[0]), int(r[-1])) for r in np.split(at, cuts)]
            begin = 0
            while begin < len(runs):
                end = begin
                while end < len(runs) and group[of[runs[end][0]]] == group[of[runs[begin][0]]]:
                    end += 1
                pieces = [(int(of[a]), int(place[a]), raw[borders[of[a]] + place[a]: borders[of[a]] + place[b] + LENGTH]) for a, b in runs[begin:end]]
                changed.update(_least_keys(pieces, keys))
                begin = end
        least = np.repeat(np.array(keys, np.int64), count)
        first = np.cumsum(count) - count
        for (stretch, where), key in changed.items():
            least[first[stretch] + where] = key
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (least[1:] != least[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(of)) - 1
        values = pa.StructArray.from_arrays(
            [pa.array((low[of[begin]] + place[begin]).astype(np.int32)), pa.array((low[of[last]] + place[last]).astype(np.int32)), pa.array(least[begin])],
            names=["low", "high", "least"])
        offsets = pa.array(np.searchsorted(of[begin], np.arange(len(group) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [table.column("group").combine_chunks(), table.column("name").combine_chunks(), pa.ListArray.from_arrays(offsets, values).cast(kind)],
            names=["group", "name", "runs"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs`` the ``spans`` of bytes that go (``start``, ``end``, by start) and the ``kept`` bytes; ``n_bytes`` is the text's."""
    read = bare(docs, key, text).toDF("key", "text").select(
        "key", F.coalesce(F.col("key").cast("bigint"), F.lit(-(1 << 63))).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    read = read.withColumns({"mark": F.xxhash64("text"), "check": F.xxhash64(F.lit(1), "text")})
    with Scratch(docs.sparkSession) as scratch:
        firsts = scratch.keep(read.groupBy("mark", "check").agg(F.min("ord").alias("ord")), "firsts")
        n = parts(read)
        rows = (
            read.filter(F.octet_length("text") >= LENGTH).select("text", "mark").mapInArrow(_marks, "anchor long, mark long")
            .repartition(n, "anchor").sortWithinPartitions("anchor", "mark").mapInArrow(_repeated, "anchor long, mark long"))
        listed = scratch.keep(rows.groupBy("mark").agg(F.collect_set("anchor").alias("anchors")).join(firsts, "mark"), "listed")
        shape = "ord long, mark long, group long, start long, low int, high int, bytes binary"
        name = F.xxhash64("bytes", "low", "high")
        stands = scratch.keep(
            read.join(listed, ["mark", "check", "ord"]).dropDuplicates(["mark", "check", "ord"]).select("ord", "mark", "text", "anchors").mapInArrow(_stretches, shape)
            .withColumn("name", name), "stands-0")
        removed, turn = None, 0
        while True:
            different = stands.groupBy("group", "name", "low", "high", "bytes").agg(F.min("ord").alias("least"))
            different = scratch.keep(different, f"different-{turn}")
            sizes = different.groupBy("group").agg(F.count("*").alias("n"))
            alone = different.join(sizes.filter("n = 1").select("group"), "group", "left_semi").select(
                "group", "name", F.array(F.struct("low", "high", "least")).alias("runs"))
            sorted_ = (
                different.join(sizes.filter((F.col("n") > 1) & (F.col("n") <= MOST)).select("group"), "group", "left_semi")
                .repartition(n, "group").sortWithinPartitions("group").select("group", "name", "low", "high", "least", "bytes")
                .mapInArrow(_decided, "group long, name long, runs array<struct<low: int, high: int, least: long>>"))
            decided = scratch.keep(alone.union(sorted_), f"decided-{turn}")
            run = (
                stands.select("ord", "mark", "group", "name", "start", "low").join(decided, ["group", "name"])
                .select("ord", "mark", "start", F.col("low").alias("base"), F.inline("runs")).filter("ord > least")
                .select("ord", "mark", (F.col("start") + F.col("low") - F.col("base")).alias("start"),
                        (F.col("start") + F.col("high") - F.col("base") + LENGTH).alias("end")))
            run = scratch.keep(run, f"removed-{turn}")
            removed = run if removed is None else removed.union(run)
            many = sizes.filter(F.col("n") > MOST).select("group")
            large = scratch.keep(different.join(many, "group", "left_semi"), f"large-{turn}")
            if large.isEmpty():
                break
            stands = scratch.keep(_refined(stands, large), f"stands-{turn + 1}")
            turn += 1
        order = Window.partitionBy("ord", "mark").orderBy("start", "end")
        reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        spans = (
            removed.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
            .withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("ord", "mark", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("ord", "mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
        facts = (
            read.select("ord", "mark", "check").distinct().join(firsts.withColumnRenamed("ord", "first"), ["mark", "check"])
            .join(spans, ["ord", "mark"], "left").filter("ord <> first or spans is not null"))
        facts = materialize(facts, "repeats")
    out = read.join(facts, ["ord", "mark", "check"], "left").withColumns({"raw": F.col("text").cast("binary"), "n_bytes": F.octet_length("text").cast("long")})
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end")))
    out = out.withColumn("spans", F.when((F.col("first") < F.col("ord")) & (F.col("n_bytes") >= LENGTH), whole).otherwise(F.coalesce("spans", none)))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array("n_bytes"))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(F.col("raw"), (a + 1).cast("int"), (b - a).cast("int")))
    kept = F.when(F.size("spans") == 0, F.col("raw")).otherwise(F.aggregate(pieces, F.lit(b""), lambda s, p: F.concat(s, p)))
    return out.select(F.col("key").alias(key), "n_bytes", "spans", kept.alias("kept"))


def _refined(stands: DataFrame, large: DataFrame) -> DataFrame:
    """Stretches of groups of too many, halved: each half of the windows by the bytes they all share."""
    halves = F.filter(
        F.array(F.struct(F.lit(0).alias("side"), F.col("low").alias("to_low"), F.least("high", "cut").alias("to_high")),
                F.struct(F.lit(1).alias("side"), F.greatest("low", F.col("cut") + 1).alias("to_low"), F.col("high").alias("to_high"))),
        lambda h: h["to_low"] <= h["to_high"])
    # The cut is the group's own, so that equal windows stay together.
    cuts = large.groupBy("group").agg(F.min("low").alias("from_low"), F.max("high").alias("to"))
    cuts = cuts.select("group", "from_low", "to", F.floor((F.col("from_low") + F.col("to")) / 2).cast("int").alias("cut"))
    part = lambda a, b: F.substring(F.col("bytes"), (a - F.col("low") + 1).cast("int"), (b - a).cast("int"))
    children = (
        large.join(cuts, "group").select("group", "name", "low", "from_low", "to", "cut", "bytes", F.explode(halves).alias("h"))
        .select("group", "name", "low", "bytes", "h.*",
                F.when(F.col("h.side") == 0, F.col("cut")).otherwise(F.col("to")).alias("last"),
                F.when(F.col("h.side") == 0, F.col("from_low")).otherwise(F.col("cut") + 1).alias("least")))
    # What all windows of the half share: from the last one's start to the first one's end.
    common = part(F.col("last"), F.col("least") + LENGTH)
    piece = part(F.col("to_low"), F.col("to_high") + LENGTH)
    children = children.select(
        "group", "name", F.xxhash64("group", "side", common).alias("to_group"), piece.alias("to_bytes"), "to_low", "to_high",
        (F.col("to_low") - F.col("low")).alias("shift")).withColumn("to_name", F.xxhash64("to_bytes", "to_low", "to_high"))
    return stands.select("ord", "mark", "group", "name", "start").join(children, ["group", "name"]).select(
        "ord", "mark", F.col("to_group").alias("group"), (F.col("start") + F.col("shift")).alias("start"), F.col("to_low").alias("low"),
        F.col("to_high").alias("high"), F.col("to_bytes").alias("bytes"), F.col("to_name").alias("name"))
