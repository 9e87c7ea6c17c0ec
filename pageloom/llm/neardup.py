"""N-gram Jaccard join by chosen paths.

Documents with the same set of word shingles are one class. A run samples a few
shingles of each class at each level, those that come first in the run's own
order; classes that share a sampled shingle meet in a bucket, and buckets of
more than ``SMALL`` classes are split again by the next level's samples. Small
buckets are compared by brute force, and so are, block by block, those that no
level has split (each class in a few of them, as they hold much the same). Two halves of the runs estimate how many linked classes no run
has found; runs go on until that is less than the target allows.

The links of a bucket leave it as a tree. Their connected components are then
compared block by block once more, which counts every link of every class
without ever listing the pairs of a group.

Defined results: a text of one to four words has all its words as its one
shingle; a null or wordless text has no shingle, no link, and is a class of its
own. Rows repeated with the same key stand for one document each. A null key is
a key like others. Extra columns are not looked at. An empty table gives none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.arrays import mix, shingles, slices, text_buffer, words
from pageloom.llm.components import components
from pageloom.llm.tables import bare, parts
from pageloom.session import Scratch, materialize

WORDS = 5
SIMILARITY = 0.8
SAMPLED = 2  # shingles sampled at each level
LEVELS = 3
RUNS = 6  # in each round; half of them against the other half estimate the recall
SMALL = 64  # classes a bucket may hold and not be split again
BLOCK = 512  # classes of a larger bucket that are compared with as many others in one task
RECALL = 0.999
ROUNDS = 5  # at most


def _multipliers(run: int) -> np.ndarray:
    """An odd number for each level of a run, by which it orders shingles."""
    return mix(np.arange(run * LEVELS, (run + 1) * LEVELS, dtype=np.uint64) + np.uint64(0xA5A5)) | np.uint64(1)


def _digests(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's set of shingles: two sums that name it, its size, its first place in ``value``."""
    first = np.searchsorted(text, np.arange(n + 1))
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(seed)), dtype=np.uint64)]) for seed in (0x51ED, 0xC0DE)]
        names = [s[first[1:]] - s[first[:-1]] for s in sums]
    return *names, np.diff(first), first


def _samples(batches: Iterator[pa.RecordBatch], key: str, text: str, runs: range) -> Iterator[pa.RecordBatch]:
    """For each document its class, the size of its set, and the samples of each run and level, in order."""
    width = len(runs) * LEVELS * SAMPLED
    for batch in batches:
        for part in slices(batch, text):
            buffer, borders = text_buffer(part.column(text))
            of, value = shingles(words(buffer, borders)[0], WORDS)
            a, b, size, first = _digests(of, value, part.num_rows)
            full = np.flatnonzero(size)
            drawn = []
            with np.errstate(over="ignore"):
                for run in runs:
                    for factor in _multipliers(run):
                        order = value * factor
                        for k in range(SAMPLED):
                            least = np.minimum.reduceat(order, first[full]) if len(full) else np.zeros(0, np.uint64)
                            # A set of fewer shingles has its last one again.
                            drawn.append(np.where(size[full] > k, least, drawn[-1]) if k else least)
                            order = np.where(order == np.repeat(least, size[full]), np.uint64(0xFFFFFFFFFFFFFFFF), order)
            picked = np.stack(drawn, axis=1) if drawn else np.zeros((0, width), np.uint64)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, width, 0))]).astype(np.int32)
            names = [struct.pack("<QQ", x, y) for x, y in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(key), part.column("mark"), pa.array(names, pa.binary()), pa.array(size.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(picked.reshape(-1).view(np.int64)))],
                names=["doc", "mark", "class", "size", "samples"])


def _key_type(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def _path(*of: Column | str) -> Column:
    return F.xxhash64(*of)


def _counted(rows: DataFrame) -> DataFrame:
    """Buckets of several classes: how many, the run, and two numbers that name the set of them."""
    return rows.groupBy("path").agg(
        F.count("*").alias("n"), F.min("run").alias("run"), F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y")).filter("n > 1")


def _once(rows: DataFrame, counts: DataFrame, runs: range) -> DataFrame:
    """The classes of the counted buckets; of buckets with the same classes, those of one."""
    half = F.when(F.col("run") < runs.start + len(runs) // 2, 1).otherwise(2)
    once = counts.withColumn("half", half).groupBy("n", "x", "y").agg(F.min("path").alias("path"), F.bit_or("half").alias("halves"))
    return rows.join(once.select("path", "halves", "n"), "path").select(F.col("path").alias("bucket"), "class", "halves", "n")


def _buckets(classes: DataFrame, runs: range, scratch: Scratch, name: str) -> DataFrame:
    """``bucket``, ``class``, ``halves`` (1, 2 or 3: the halves of the runs it is from), ``n`` for buckets to compare.

    Buckets with the same classes are kept once.
    """
    at = lambda run, level, k: (run - runs.start) * LEVELS * SAMPLED + level * SAMPLED + k
    choices = F.array(*[
        F.struct(F.lit(run).alias("run"), F.get("samples", F.lit(at(run, 0, k))).alias("shingle")) for run in runs for k in range(SAMPLED)])
    rows = scratch.keep(
        classes.select("class", F.explode(F.array_distinct(choices)).alias("c"))
        .select("class", F.col("c.run").alias("run"), _path(F.lit(0), "c.run", "c.shingle").alias("path")), f"{name}-level-0")
    kept = []
    for level in range(LEVELS):
        counts = scratch.keep(_counted(rows), f"{name}-counts-{level}")
        last = level == LEVELS - 1
        kept.append(_once(rows, counts.filter(F.col("n") <= SMALL), runs))
        # In what is split again, and in what no level has split, classes alike meet in many buckets: each stays in SAMPLED of a run's.
        order = Window.partitionBy("class", "run").orderBy("path")
        large = rows.join(counts.filter(F.col("n") > SMALL).select("path"), "path", "left_semi")
        large = large.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLED).drop("k")
        if last:
            large = scratch.keep(large, f"{name}-large")
            kept.append(_once(large, _counted(large), runs))
        else:
            here = F.transform(
                F.sequence(F.lit(0), F.lit(SAMPLED - 1)),
                lambda k, level=level: F.get("samples", ((F.col("run") - runs.start) * LEVELS * SAMPLED + (level + 1) * SAMPLED + k).cast("int")))
            rows = scratch.keep(
                large.join(classes.select("class", "samples"), "class").select("class", "run", "path", F.explode(F.array_distinct(here)).alias("shingle"))
                .select("class", "run", _path(F.lit(level + 1), "path", "shingle").alias("path")), f"{name}-level-{level + 1}")
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return scratch.keep(out, f"{name}-buckets")


def _units(members: DataFrame, group: str) -> DataFrame:
    """Rows of ``members`` (``n``: the size of the group) by the units they are compared in: pairs of blocks of a group.

    A group of one block has one unit. Each of ``k`` blocks is in ``k`` units, so
    no task holds more than two blocks, however large the group.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.col("class"), F.lit(7)), F.col("blocks")).cast("int")
    return (
        members.withColumn("blocks", blocks).withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("unit", F.xxhash64(F.col(group), F.least("block", "other"), F.greatest("block", "other"))))


def _runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted rows in tables, one for each value of a column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(column)[0].as_py() != values[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _linked(texts: pa.ChunkedArray) -> np.ndarray:
    """Which of the texts are as similar as is asked, as a matrix; exact."""
    buffer, borders = text_buffer(texts)
    of, value = shingles(words(buffer, borders)[0], WORDS)
    k, size = len(texts), np.bincount(of, minlength=len(texts))
    order = np.argsort(value, kind="stable")
    of, value = of[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    of, number = of[shared], number[shared]
    common = np.zeros((k, k), np.float64)
    number = np.unique(number, return_inverse=True)[1]
    n, step = int(number[-1]) + 1 if len(number) else 0, max(1, (1 << 20) // k)  # shingles in all, and compared at once
    for start in range(0, n, step):
        low, high = np.searchsorted(number, [start, start + step])
        if high > low:
            has = np.zeros((k, min(step, n - start)), np.float32)
            has[of[low:high], number[low:high] - start] = 1
            common += has @ has.T
    linked = common >= SIMILARITY * (size[:, None] + size[None, :] - common) - 1e-9
    linked &= common > 0
    np.fill_diagonal(linked, False)
    return linked


def _pairs_of_blocks(table: pa.Table, linked: np.ndarray) -> np.ndarray:
    """Leaves out the links inside the blocks of a unit of two blocks: those are of the blocks' own units."""
    block = table.column("block").to_numpy()
    if table.column("block")[0].as_py() != table.column("other")[0].as_py() or (block != block[0]).any():
        linked = linked & (block[:, None] != block[None, :])
    return linked


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linked classes of each unit, each with the first it is connected with there."""
    for table in _runs_of(batches, "unit"):
        linked = _pairs_of_blocks(table, _linked(table.column("text")))
        names, root = table.column("class").to_pylist(), np.arange(table.num_rows)
        while True:  # each takes the first of its neighbours' firsts, until none changes
            nearest = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
            nearest = nearest[nearest]
            if (nearest == root).all():
                break
            root = nearest
        edges = [(names[r], names[x]) for x, r in enumerate(root.tolist()) if r != x]
        if edges:
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary()),
                 pa.array([table.column("halves")[0].as_py()] * len(edges), pa.int32())], names=["a", "b", "halves"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many classes, and how many documents of those, each class of a unit is linked with there."""
    for table in _runs_of(batches, "unit"):
        linked = _pairs_of_blocks(table, _linked(table.column("text")))
        copies = table.column("copies").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [table.column("class").combine_chunks(), pa.array(linked.sum(axis=1)), pa.array(linked @ copies)], names=["class", "texts", "links"])


def _compare(units: DataFrame, texts: DataFrame, how, schema: str, *extra: str) -> DataFrame:
    n = parts(units)
    return (
        units.select("unit", "class", "block", "other", *extra).join(texts, "class")
        .repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(how, schema))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its group, its copies, its number of links.

    ``class_id``: the smallest key of the documents it is linked with, directly
    or through others; ``copy_id``: the smallest key of those with its very set
    of shingles; ``n_links``: the documents with a Jaccard similarity of at
    least ``SIMILARITY``, copies included; ``n_texts``: the different sets among them;
    ``text_hash``: tells rows with one key apart.
    """
    read = bare(docs, key, text).toDF("doc", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = _key_type(docs, key)
    with Scratch(docs.sparkSession) as scratch:
        shape = f"doc {kind}, mark long, class binary, size long, samples array<long>"
        edges, total, found = None, 1.0, 0.0
        for turn in range(ROUNDS):
            runs = range(turn * RUNS, (turn + 1) * RUNS)
            sampled = scratch.keep(read.mapInArrow(lambda it, runs=runs: _samples(it, "doc", "text", runs), shape), f"sampled-{turn}")
            filled = sampled.filter("size > 0")
            classes = scratch.keep(
                filled.groupBy("class").agg(F.min("doc").alias("doc"), F.min(F.struct("doc", "mark")).alias("pick"), F.count("*").alias("copies"), F.first("samples").alias("samples")), f"classes-{turn}")
            buckets = _buckets(classes, runs, scratch, f"turn-{turn}")
            texts = scratch.keep(_texts(read, classes, buckets.select("class").distinct()), f"texts-{turn}")
            new = scratch.keep(_compare(_units(buckets, "bucket"), texts, _trees, "a binary, b binary, halves int", "halves"), f"edges-{turn}")
            edges = new if edges is None else edges.union(new)
            total, found = _estimate(edges, turn)
            if found >= RECALL * total:
                break
        if edges.isEmpty():
            groups, linked = None, None
        else:
            roots = components(edges, "a", "b", scratch, "groups")
            sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
            members = roots.withColumnRenamed("node", "class").join(sizes, "root").join(classes.select("class", "copies"), "class")
            members = scratch.keep(members, "members")
            linked = (
                _compare(_units(members, "root"), scratch.keep(_texts(read, classes, members.select("class")), "texts"), _counts,
                         "class binary, texts long, links long", "copies")
                .groupBy("class").agg(F.sum("texts").alias("n_texts"), F.sum("links").alias("n_links")))
            groups = members.join(classes.select("class", "doc"), "class")
            groups = groups.select("class", "root").join(groups.groupBy("root").agg(F.min("doc").alias("class_id")), "root").select("class", "class_id")
        facts = classes.select("class", F.col("doc").alias("copy_id"), "copies")
        if groups is None:
            facts = facts.withColumns({"class_id": F.col("copy_id"), "n_texts": F.lit(0).cast("long"), "n_links": F.lit(0).cast("long")})
        else:
            facts = facts.join(groups, "class", "left").join(linked, "class", "left").withColumn("class_id", F.coalesce("class_id", "copy_id"))
        facts = scratch.keep(facts, "facts")
        # Most classes hold one document; the join with a class of very many is split by the planner, a class being one row.
        out = sampled.filter("size > 0").join(facts, "class").select(
            F.col("doc").alias(key), F.col("mark").alias("text_hash"), "class_id", "copy_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("n_texts", F.lit(0)).alias("n_texts"))
        empty = sampled.filter("size = 0").select(
            F.col("doc").alias(key), F.col("mark").alias("text_hash"), F.col("doc").alias("class_id"), F.col("doc").alias("copy_id"), F.lit(0).cast("long").alias("n_links"),
            F.lit(0).cast("long").alias("n_texts"))
        return materialize(out.union(empty), "jaccard")


def _texts(read: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each class that is wanted, found by its key and its hash."""
    keys = wanted.join(classes.select("class", "pick"), "class").select("class", F.col("pick.doc").alias("of"), F.col("pick.mark").alias("mark"))
    return (
        read.join(keys, [read["doc"].eqNullSafe(keys["of"]), read["mark"] == keys["mark"]])
        .select("class", "text").dropDuplicates(["class"]))


def _estimate(edges: DataFrame, turn: int) -> tuple[float, float]:
    """The classes with a link, as estimated from what each half of the runs found, and those found."""
    ends = edges.select(F.col("a").alias("node"), "halves").union(edges.select("b", "halves")).groupBy("node").agg(F.bit_or("halves").alias("halves"))
    row = ends.agg(
        F.count("*").alias("all"), F.count_if(F.col("halves").bitwiseAND(1) > 0).alias("one"), F.count_if(F.col("halves").bitwiseAND(2) > 0).alias("two"),
        F.count_if(F.col("halves") == 3).alias("both")).first()
    if not row.all:
        return 0.0, 0.0
    if not row.both:
        return float("inf"), float(row.all)
    return row.one * row.two / row.both, float(row.all)
