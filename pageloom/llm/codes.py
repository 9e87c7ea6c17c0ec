"""Codes of vectors, part by part, by Lloyd's rounds over two trees.

Vectors become integers and are cut into equal parts; each part position has a
codebook, and a part's code is the number of the entry nearest to it. A round
assigns every part and replaces each entry by the floored mean of its parts.

Parts lie in blocks of some thousand vectors. Within a block the parts of a position are
ordered once as a balanced tree (halved at the median of the widest component),
so that every node is a stretch of that order. The entries of a codebook make
a tree in the same way. Both are descended together: a pair of nodes is dropped where
the boxes around them are farther apart than the farthest distance to some other node
of entries, or where every corner of the box of parts is nearer to another entry. A node of
parts left with one entry is assigned as a whole from running sums; in leaves
that stay uncertain the distances to the entries left are computed, in
integers, for each part. Nothing is lost by the bounds: they drop only entries that are
farther than another one from all parts of a node, so ties are met in leaves.

Blocks are written in their order once and read in each round; a round brings the
sums of each entry, a few thousand numbers, to the driver.

Defined results: rows with a null vector, or one with null or non-finite
components, are dropped, and so are vectors that are not as long as the one
with the smallest key, or that hold fewer components than there are parts. Where the length is
no multiple of the parts, the first ones are one component longer. Rows with a null
key are coded and come last in the order that begins the codebooks; repeated rows are rows of their own, and equal keys
are ordered by their vectors. With fewer vectors than entries the codebooks are shorter. An integer component
of ``2 ** 24`` or more in size is an error. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.skew import join_by_group
from pageloom.llm.tables import bare
from pageloom.session import Scratch, materialize

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 21  # vectors of a block, and components
LEAF = 16  # parts of a leaf at least
LIMIT = 1 << 24


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and the last one ends."""
    return [j * (length // parts) + min(j, length % parts) for j in range(parts + 1)]


def borders(n: int, level: int) -> np.ndarray:
    """The stretches that halving ``n`` places ``level`` times makes; those of one level lie in those of the level before."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def depth(n: int, leaf: int) -> int:
    """How often ``n`` places can be halved so that ``leaf`` are left in each stretch."""
    return max(0, (n // leaf).bit_length() - 1)


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of points in which every stretch of :func:`borders` is a node of a tree halved at medians."""
    n = len(points)
    order = np.arange(n)
    for level in range(depth(n, leaf)):
        edge = borders(n, level)
        here = points[order]
        wide = (np.maximum.reduceat(here, edge[:-1]) - np.minimum.reduceat(here, edge[:-1])).argmax(1)
        node = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        order = order[np.lexsort((here[np.arange(n), wide[node]], node))]
    return order


class Boxes:
    """The box around each node of a tree, by levels; points are in the tree's order."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.depth = depth(len(points), leaf)
        self.edges = [borders(len(points), level) for level in range(self.depth + 1)]
        low, high = [np.minimum.reduceat(points, self.edges[-1][:-1])], [np.maximum.reduceat(points, self.edges[-1][:-1])]
        for _ in range(self.depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
        self.low, self.high = low[::-1], high[::-1]


def _first_of(sorted_numbers: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_numbers[1:] != sorted_numbers[:-1]]))


def assign(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point, ties to the first, with sums and counts of each entry's points.

    Points are integers in the order of their tree. Nodes assigned as a whole give their sums from running sums.
    """
    n, width = points.shape
    by_tree = tree_order(entries, 1)
    data, book = Boxes(points, LEAF), Boxes(entries[by_tree], 1)
    running = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(points, 0)])
    code = np.full(n, -1, np.int64)
    sums, counts = np.zeros((len(entries), width), np.int64), np.zeros(len(entries), np.int64)
    level = level_of_book = 0
    node = part = np.zeros(1, np.int64)  # pairs of a node of points and a node of entries, in order of the first
    while True:
        last = level_of_book == book.depth
        low, high = data.low[level][node], data.high[level][node]
        e_low, e_high = book.low[level_of_book][part], book.high[level_of_book][part]
        least = (np.maximum(np.maximum(e_low - high, low - e_high), 0) ** 2).sum(1)
        most = (np.maximum(high - e_low, e_high - low) ** 2).sum(1)
        first = _first_of(node)
        size = np.diff(np.append(first, len(node)))
        bound = np.repeat(np.minimum.reduceat(most, first), size)
        keep = least <= bound
        if last and len(entries) == len(book.edges[-1]) - 1:
            # One entry a node: against the entry nearest to the middle, at the corner that favours the other one most.
            middle = ((2 * e_low - low - high) ** 2).sum(1)
            near = e_low[first + _place_of_least(middle, first, size)].repeat(size, 0)
            corner = np.where(e_low > near, high, low)
            keep &= ((corner - e_low) ** 2).sum(1) <= ((corner - near) ** 2).sum(1)
        node, part = node[keep], part[keep]
        first = _first_of(node)
        size = np.diff(np.append(first, len(node)))
        if last:
            edge = book.edges[-1]
            sure = (size == 1) & (edge[part[first] + 1] - edge[part[first]] == 1)
            if sure.any():
                whole, entry = node[first][sure], by_tree[edge[part[first][sure]]]
                start, end = data.edges[level][whole], data.edges[level][whole + 1]
                np.add.at(sums, entry, running[end] - running[start])
                np.add.at(counts, entry, end - start)
                code[_ranges(start, end)] = np.repeat(entry, end - start)
                left = np.repeat(~sure, size)
                node, part = node[left], part[left]
        if not len(node) or (last and level == data.depth):
            break
        if level < data.depth:
            level += 1
            node, part = _halves(node, part, first_child=True)
        if not last:
            level_of_book += 1
            node, part = _halves(node, part, first_child=False)
    if len(node):
        _uncertain(points, entries, data, book.edges[-1], by_tree, node, part, code, sums, counts)
    return code, sums, counts


def _place_of_least(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Within each run, the place of a smallest value."""
    hit = np.flatnonzero(values == np.repeat(np.minimum.reduceat(values, first), size))
    run = np.repeat(np.arange(len(first)), size)[hit]
    return hit[_first_of(run)] - first


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to before its end."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _halves(node: np.ndarray, part: np.ndarray, first_child: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with both children of one side in its place, in order of the first side."""
    if first_child:
        first = _first_of(node)
        size = np.diff(np.append(first, len(node)))
        order = _ranges(np.repeat(first, 2), np.repeat(first + size, 2))
        half = np.repeat(np.tile([0, 1], len(first)), np.repeat(size, 2))
        return 2 * node[order] + half, part[order]
    return np.repeat(node, 2), (2 * part[:, None] + [0, 1]).ravel()


def _uncertain(points, entries, data, edge, by_tree, node, part, code, sums, counts) -> None:
    """Distances of each part in the leaves left to each entry left there."""
    size = edge[part + 1] - edge[part]
    node, entry = np.repeat(node, size), by_tree[_ranges(edge[part], edge[part + 1])]
    start, end = data.edges[-1][node], data.edges[-1][node + 1]
    wide = int((end - start).max())
    at = start[:, None] + np.arange(wide)
    inside = at < end[:, None]
    at = np.where(inside, at, start[:, None])
    distance = np.zeros(at.shape, np.int64)
    for c in range(points.shape[1]):
        distance += (points[at, c] - entries[entry, c][:, None]) ** 2
    first = _first_of(node)
    best = np.minimum.reduceat(distance * len(entries) + entry[:, None], first)[inside[first]] % len(entries)
    place = at[first][inside[first]]
    code[place] = best
    np.add.at(counts, best, 1)
    np.add.at(sums, best, points[place])


# --- Spark -----------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def _blocks(batches: Iterator[pa.RecordBatch], at: list[int]) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // at[-1]))
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            block = batch.slice(low, rows)
            vectors = block.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, at[-1])
            vectors = np.floor(vectors * SCALE)
            if np.abs(vectors).max(initial=0) >= LIMIT:
                raise ValueError(f"a component of {LIMIT} or more in size")
            vectors = vectors.astype(np.int32)
            orders, points = [], []
            for a, b in zip(at, at[1:]):
                order = tree_order(vectors[:, a:b].astype(np.int64), LEAF)
                orders.append(order.astype("<i4").tobytes())
                points.append(vectors[order, a:b].astype("<i4").tobytes())
            one = [pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(c)) for c in ("key", "label")]
            yield pa.RecordBatch.from_arrays(
                [*one, pa.array([b"".join(orders)], pa.binary()), pa.array([b"".join(points)], pa.binary())], names=["keys", "labels", "orders", "points"])


def _points(raw: bytes, n: int, at: list[int]) -> list[np.ndarray]:
    flat = np.frombuffer(raw, "<i4").astype(np.int64)
    return [flat[n * a: n * b].reshape(n, b - a) for a, b in zip(at, at[1:])]


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], at: list[int]) -> Iterator[pa.RecordBatch]:
    """What each entry's parts sum up to, and how many there are (as component -1)."""
    sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        for keys, raw in zip(batch.column("keys"), batch.column("points")):
            for j, points in enumerate(_points(raw.as_py(), len(keys), at)):
                _, s, c = assign(points, books[j])
                sums[j] += s
                counts[j] += c
    for j, (s, c) in enumerate(zip(sums, counts)):
        used = np.flatnonzero(c)
        width = s.shape[1] + 1
        total = np.concatenate([c[used, None], s[used]], 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used) * width, j, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)),
             pa.array(np.tile(np.arange(-1, width - 1, dtype=np.int32), len(used))), pa.array(total.ravel())], names=["part", "entry", "component", "total"])


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], at: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            keys, labels = (batch.column(c)[row].values for c in ("keys", "labels"))
            n = len(keys)
            orders = np.frombuffer(batch.column("orders")[row].as_py(), "<i4").reshape(-1, n)
            codes, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
            for j, points in enumerate(_points(batch.column("points")[row].as_py(), n, at)):
                code, _, _ = assign(points, books[j])
                codes[orders[j], j] = code
                error[orders[j]] += ((points - books[j][code]) ** 2).sum(1)
            digits, width = codes.tobytes().hex(), 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [keys, labels, pa.array([digits[i * width: (i + 1) * width] for i in range(n)]), pa.array(error)], names=["key", "label", "code", "error"])


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Each kept vector's ``code`` (two hex digits a part), ``error`` and ``label_error``, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: from 1 to 256 entries")
    spark = vectors.sparkSession
    read = bare(vectors, key, vector, label).toDF("key", "vector", "label").filter(usable(F.col("vector")))
    read = read.filter(F.size("vector") >= parts)
    order = [F.col("key").asc_nulls_last(), F.col("vector").asc()]
    first = read.orderBy(*order).limit(1).collect()
    if not first:
        schema = f"`{key}` {vectors.schema[key].dataType.simpleString()}, label {vectors.schema[label].dataType.simpleString()}, code string, error long, label_error long"
        return spark.createDataFrame([], schema), []
    length = len(first[0]["vector"])
    read = read.filter(F.size("vector") == length)
    starts = np.floor(np.array([r["vector"] for r in read.orderBy(*order).limit(entries).collect()], np.float64) * SCALE)
    if np.abs(starts).max() >= LIMIT:
        raise ValueError(f"a component of {LIMIT} or more in size")
    at = cuts(length, parts)
    books = [starts[:, a:b].astype(np.int64) for a, b in zip(at, at[1:])]
    with Scratch(spark) as scratch:
        types = {c: read.schema[c].dataType.simpleString() for c in ("key", "label")}
        blocks = scratch.keep(read.mapInArrow(
            lambda it: _blocks(it, at), f"keys array<{types['key']}>, labels array<{types['label']}>, orders binary, points binary"), "blocks")
        for _ in range(rounds):
            shipped = books
            sums = blocks.select("keys", "points").mapInArrow(
                lambda it: _sums(it, shipped, at), "part int, entry int, component int, total long")
            found = sums.groupBy("part", "entry", "component").agg(F.sum("total").alias("total")).collect()  # the size of the codebooks
            total = {(r["part"], r["entry"], r["component"]): r["total"] for r in found}
            books = [b.copy() for b in books]
            for (j, e, c), count in total.items():
                if c < 0:
                    books[j][e] = [total[j, e, i] // count for i in range(books[j].shape[1])]
        final = books
        coded = scratch.keep(blocks.mapInArrow(
            lambda it: _coded(it, final, at), f"key {types['key']}, label {types['label']}, code string, error long"), "coded")
        # Labels as text, so that nulls are a group of their own.
        coded = coded.withColumn("of", F.to_json(F.struct("label")))
        groups = coded.groupBy("of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
        out = join_by_group(coded, scratch.keep(groups, "labels"), "of", "n", coded.count())
        out = materialize(out.select(F.col("key").alias(key), "label", "code", "error", "label_error"), "codes")
    return out, books
